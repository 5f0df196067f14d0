"""Exact distinct counts that can be stored and merged: bitmaps of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "balde", "mapa"


def distinct_bitmaps(df: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """Per key and bucket of 32768 ids, a bitmap of the ids that occur; null ids do not count.

    A group that holds most rows is combined before the shuffle, which carries a bitmap per task and bucket.
    """
    bits = df.where(F.col(id_col).isNotNull()).select(
        *keys,
        F.bitmap_bucket_number(F.col(id_col).cast("bigint")).alias(BUCKET),
        F.bitmap_bit_position(F.col(id_col).cast("bigint")).alias("posicao"),
    )
    return bits.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg("posicao").alias(BITS))


def count_distinct_merged(bitmaps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The number of different ids per group: bitmaps of a bucket are laid over each other, then counted."""
    merged = bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_count(F.bitmap_or_agg(BITS)).alias("ids"))
    return merged.groupBy(*by).agg(F.sum("ids").alias(name))
