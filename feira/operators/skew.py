"""Joins on keys that a few values may dominate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def own_key(key: Column) -> Column:
    """``key`` as a join key for which neither side counts as laid out already.

    AQE splits a hot partition only when both sides of a join arrive through
    shuffles of that join. A side that a grouping or another join has laid out by the same
    column skips its shuffle and the hot key stays in one task; under this key it does not.
    """
    return F.struct(key.alias("key"))
