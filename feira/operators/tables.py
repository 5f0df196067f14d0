"""Stored tables: full refresh, publication and read-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PERIOD_FOLDERS = ("ano", "trimestre")


def refresh_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    newest_first: str | None = None,
) -> DataFrame:
    """Replace the table at ``path`` with ``df`` and read it back.

    Rows are rebalanced by the folder columns: AQE splits a quarter that holds
    much of the table over many tasks and packs small ones together, so files
    come out near the advisory size whatever the skew. ``newest_first`` sorts
    inside each file by that column, which gives its row groups narrow ranges; a
    stored table has no global order.
    """
    writer = _replacing(laid_out(df, partition_by, newest_first))
    writer.partitionBy(*partition_by).parquet(path)
    # the written order of columns differs: folder columns come last
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def create_table(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), newest_first: str | None = None
) -> DataFrame:
    """Drop catalog table ``name`` if it exists, create it from ``df`` and read it."""
    writer = _replacing(laid_out(df, partition_by, newest_first)).format("parquet")
    writer.partitionBy(*partition_by).saveAsTable(name)
    return df.sparkSession.table(name).select(*df.columns)


def _replacing(df: DataFrame) -> DataFrameWriter:
    """A writer that replaces the whole table, also where the session overwrites by partition."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "static")


def laid_out(df: DataFrame, partition_by: Sequence[str], newest_first: str | None) -> DataFrame:
    """``df`` rebalanced by the folder columns and sorted inside files."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    if newest_first:
        out = out.sortWithinPartitions(*partition_by, F.desc(newest_first))
    return out


def publish(spark: SparkSession, view: str, path: str, schema: StructType) -> None:
    """Point ``view`` at the table of ``schema`` stored in ``path``.

    Refresh into a new folder, then publish: readers see the old table or the
    new one, never a half-written one. A table without rows has no files to
    take a schema from, so its view is made from ``schema``.
    """
    columns = [f"CAST({{}} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields]
    if spark.read.schema(schema).parquet(path).isEmpty():
        body = f"SELECT {', '.join(c.format('NULL') for c in columns)} WHERE false"
    else:
        named = (c.format(f"`{f.name}`") for c, f in zip(columns, schema.fields))
        body = f"SELECT {', '.join(named)} FROM parquet.`{path}`"
    spark.sql(f"CREATE OR REPLACE VIEW {view} AS {body}")
