"""Several groupings of one table in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.functions.text import BINARY, collated

SET = "conjunto"


def set_number(dims: Sequence[str], members: Sequence[str]) -> int:
    """The grouping id of a set of dimensions: a bit per dimension that is not in it, the last one lowest."""
    return sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in members)


def by_each(df: DataFrame, dims: Sequence[str], aggs: dict[str, Column], *, whole: bool = False) -> DataFrame:
    """Aggregate by each of ``dims`` alone, and with ``whole`` over everything, in one scan and one shuffle.

    Grouping sets make a row per set and input row, combined before the shuffle. ``conjunto`` is the
    grouping id (see :func:`set_number`); the columns of other dimensions are null.
    """
    sets = [[F.col(d)] for d in dims] + ([[]] if whole else [])
    totals = [a.alias(name) for name, a in aggs.items()]
    return df.groupingSets(sets, *(F.col(d) for d in dims)).agg(F.grouping_id(*dims).alias(SET), *totals)


def count_by_each(df: DataFrame, dims: Sequence[str], collation: dict[str, str] | None = None) -> DataFrame:
    """``dimensao, valor, n``: the non-null count of each dimension's values, as :func:`count_by` gives one by one.

    ``collation`` names the dimensions that are grouped under one; their label is the smallest text.
    """
    collation = {d: c for d, c in (collation or {}).items() if c != BINARY}
    keys = {d: f"grupo_{d}" if d in collation else d for d in dims}
    keyed = df.select(*dims, *(collated(F.col(d), c).alias(keys[d]) for d, c in collation.items()))
    aggs = {f"n_{d}": F.count(d) for d in dims} | {f"rotulo_{d}": F.min(d) for d in collation}
    grouped = by_each(keyed, list(keys.values()), aggs)

    def of_set(name: str) -> Column:
        choice = F.lit(None)
        for d in dims:
            value = {"dimensao": F.lit(d), "n": F.col(f"n_{d}")}.get(name)
            if value is None:
                value = F.col(f"rotulo_{d}" if d in collation else d).cast("string")
            choice = F.when(F.col(SET) == set_number(list(keys.values()), [keys[d]]), value).otherwise(choice)
        return choice.alias(name)

    return grouped.select(*(of_set(c) for c in ("dimensao", "valor", "n")))
