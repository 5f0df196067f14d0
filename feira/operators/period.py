"""Calendar columns and period filters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.config import Quarter
from feira.functions.dates import iso_date, month_start, quarter_token


def with_period(df: DataFrame, date_text: str) -> DataFrame:
    """Add the calendar columns of timestamp column ``time``.

    ``dia`` and ``mes`` (DATE), ``ano`` and ``trimestre`` (INT) are the truth
    reports work on; ``date_text`` (ISO) and ``quarter`` (``Q-YYYY``) are for
    output.
    """
    t = F.col("time")
    year, quarter = F.year(t), F.quarter(t)
    return df.withColumns(
        {
            date_text: iso_date(t),
            "quarter": quarter_token(year, quarter),
            "dia": F.to_date(t),
            "mes": month_start(t),
            "ano": year,
            "trimestre": quarter,
        }
    )


def quarter_ranges(quarters: Iterable[Quarter]) -> list[tuple[date, date]]:
    """Half-open date ranges covering the quarters, neighbours merged."""
    ordinals = sorted({year * 4 + q - 1 for year, q in quarters})
    runs = []
    for _, run in groupby(enumerate(ordinals), lambda p: p[1] - p[0]):
        members = [n for _, n in run]
        runs.append((_quarter_start(members[0]), _quarter_start(members[-1] + 1)))
    return runs


def _quarter_start(ordinal: int) -> date:
    return date(ordinal // 4, ordinal % 4 * 3 + 1, 1)


def in_quarters(df: DataFrame, quarters: Iterable[Quarter]) -> DataFrame:
    """Rows whose ``(ano, trimestre)`` is one of the quarters.

    On a stored table that prunes folders. A raw table has no such columns to
    prune by, so the same period as a range on ``time`` (where the table has
    it) goes along and reaches the scan.
    """
    quarters = set(quarters)
    if "time" in df.columns:
        ranges = [
            f"(time >= TIMESTAMP_NTZ'{lo}' AND time < TIMESTAMP_NTZ'{hi}')"
            for lo, hi in quarter_ranges(quarters)
        ]
        df = df.where(_any(ranges))
    return df.where(in_quarters_expr(quarters))


def in_quarters_expr(quarters: Iterable[Quarter]) -> Column:
    """Condition: ``(ano, trimestre)`` is one of the quarters."""
    years = groupby(sorted(set(quarters)), lambda p: p[0])
    return F.expr(
        _any(
            f"(ano = {year} AND trimestre IN ({', '.join(str(q) for _, q in pairs)}))"
            for year, pairs in years
        )
    )


def _any(conditions: Iterable[str]) -> str:
    return " OR ".join(conditions) or "false"


def in_quarter_tokens(tokens: Iterable[str]) -> Column:
    """Condition: the ``quarter`` text is one of ``tokens``, compared as it stands."""
    return F.col("quarter").isin(list(tokens))
