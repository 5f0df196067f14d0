"""Tables clustered by a key, with an index of what each file holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE, LOW, HIGH = "arquivo", "de", "ate"


def store_clustered(df: DataFrame, path: str, key: str, within: str, files: int | None = None) -> None:
    """Replace the table at ``path`` by ``df`` in ranges of ``key``, then of ``within``, and index its files.

    Ranges are cut at sampled splitters over both columns, so that a key which holds much of the table is split over
    many files. The index has a row per file with the least and greatest key; rows without a key are in files of
    theirs or stand before all others in a file.
    """
    ranges = [key, within]
    dealt = df.repartitionByRange(files, *ranges) if files else df.repartitionByRange(*ranges)
    dealt.sortWithinPartitions(*ranges).write.mode("overwrite").parquet(f"{path}/linhas")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/linhas")
    bounds = stored.groupBy(F.col("_metadata.file_path").alias(FILE)).agg(
        F.min(key).alias(LOW), F.max(key).alias(HIGH), F.count(F.lit(1)).alias("linhas")
    )
    bounds.write.mode("overwrite").parquet(f"{path}/indice")


def read_range(
    spark: SparkSession, path: str, schema: StructType, key: str, low, high
) -> tuple[DataFrame, list[str]]:
    """Rows with ``low <= key <= high``, and the files that are opened for them.

    The names of the files that overlap the range come to the driver, no others.
    """
    index = spark.read.parquet(f"{path}/indice")
    hits = index.where((F.col(HIGH) >= F.lit(low)) & (F.col(LOW) <= F.lit(high))).select(FILE)
    names = sorted(r[0] for r in hits.collect())
    if not names:
        return spark.createDataFrame([], schema), names
    return spark.read.schema(schema).parquet(*names).where(F.col(key).between(low, high)), names
