"""Aggregations the reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from feira.functions.dates import month_label
from feira.functions.text import BINARY, collated

MONEY_TOTAL = "decimal(38,2)"


def total(amount: str) -> Column:
    """Exact decimal sum; NULL over no rows."""
    return F.sum(amount).cast(MONEY_TOTAL)


def by_text(df: DataFrame, text: str, label: str, collation: str, *keys: str) -> GroupedData:
    """Group by ``text`` under a collation, and by ``keys``; see :func:`text_label`."""
    key = collated(F.col(text), collation).alias(label if collation == BINARY else "texto")
    return df.groupBy(*keys, key)


def text_label(text: str, label: str, collation: str) -> list[Column]:
    """The name of a group that a collation merged: its smallest text, whatever the row order."""
    return [] if collation == BINARY else [F.min(text).alias(label)]


def count_by(df: DataFrame, dim: str, name: str, collation: str = BINARY) -> DataFrame:
    """Non-NULL count of ``dim`` per value of ``dim``: its NULL group counts 0."""
    aggs = [*text_label(dim, dim, collation), F.count(dim).alias(name)]
    return by_text(df, dim, dim, collation).agg(*aggs).select(dim, name)


def monthly(df: DataFrame, month: str | Column, *aggs: Column, keep_month: bool = False) -> DataFrame:
    """Aggregate per calendar month under the label ``mes_ano``.

    Groups by the month's DATE and renders the label afterwards, on the few
    result rows. ``keep_month`` adds that DATE as ``mes``, for calendar order.
    """
    key = F.col(month) if isinstance(month, str) else month
    grouped = df.groupBy(key.alias("mes")).agg(*aggs)
    labelled = grouped.withColumn("mes_ano", month_label(F.col("mes")))
    values = [c for c in grouped.columns if c != "mes"]
    return labelled.select("mes_ano", *(["mes"] if keep_month else []), *values)


def per_client(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregate per client next to one name and e-mail, the smallest of each.

    The string minima make this a sort aggregate. It still combines before the
    one shuffle, and measured faster than hashing by (client, name, e-mail)
    first or than joining the names on afterwards, which shuffle twice.
    """
    return df.groupBy("cliente_id").agg(
        F.min("nome").alias("nome"), F.min("email").alias("email"), *aggs
    )
