"""Running totals in a global order, for tables and groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feira.llm import store


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], amounts: Sequence[str], folder: str) -> DataFrame:
    """``df`` with ``<amount>_until`` for each amount: its total over the rows of the group up to and with this one.

    Rows are dealt into ranges of (group, order), so a group of any size lies in many tasks; each range is
    summed on its own, and the sums of the ranges before it are added. The order must be total
    and neither it nor the group may be null, but for rows that are alike. The ranges are stored: they are drawn once.
    """
    ranged = df.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id())
    placed = store.stored(ranged, f"{folder}/placed")
    sums = placed.groupBy("part", *by).agg(*(F.sum(a).alias(f"{a}_sum") for a in amounts))
    # a row for each range and group: without groups at most as many rows as ranges
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "part", *by, *(F.coalesce(F.sum(f"{a}_sum").over(earlier), F.lit(0)).alias(f"{a}_before") for a in amounts)
    )
    before = store.stored(before, f"{folder}/before")
    here = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = {f"{a}_until": F.sum(a).over(here) for a in amounts}
    joined = placed.withColumns(totals).join(before, ["part", *by])
    return joined.select(
        *df.columns, *((F.col(f"{a}_until") + F.col(f"{a}_before")).alias(f"{a}_until") for a in amounts)
    )
