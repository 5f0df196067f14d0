"""Multikey quicksort over numpy columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def multikey_order(key: Callable[[int, np.ndarray], np.ndarray], n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``n`` strings of ``depth`` characters, and the common prefix of each with the one before.

    ``key(d, items)`` gives character ``d`` of the items. As in multikey
    quicksort, each pass orders by one character and only runs that are equal
    so far go on to the next. A character may be a whole 64-bit word. Equal
    strings stay in their first order.
    """
    order = np.argsort(key(0, np.arange(n)), kind="stable")
    common = np.zeros(n, np.int64)
    if n < 2:
        return order, common
    first = key(0, order)
    tied = np.zeros(n + 1, bool)
    tied[1:n] = first[1:] == first[:-1]
    common[tied[:-1]] = 1
    for d in range(1, depth):
        live = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(live):
            break
        run = np.cumsum(~tied[:-1])[live]
        items = order[live]
        k = key(d, items)
        by = np.lexsort((k, run))
        order[live], k = items[by], k[by]
        still = np.zeros(n + 1, bool)
        still[live[1:]] = tied[live[1:]] & (k[1:] == k[:-1])
        tied = still
        common[tied[:-1]] = d + 1
    return order, common
