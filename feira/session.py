"""Session settings the plans rely on."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Joins carry no broadcast hints: Catalyst compares the estimated size with
# spark.sql.autoBroadcastJoinThreshold and AQE compares the measured one. Past
# the threshold a join shuffles, and these settings split its hot partitions,
# also when that costs another exchange further up.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# A join of few rows of a large table, such as one quarter's orders, with a grouping of another, such as their lines,
# tells the scan of the other which keys it can meet. Spark's own limits leave that out under 10 GB of the one
# and over 10 MB of the other. The filter takes 4 MB and passes 2 % of other keys at 4 million.
RUNTIME_FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 25),
}


# One shuffle partition per this much input: the plans shuffle a few narrow
# columns of each row. AQE merges partitions that turn out small and splits hot ones.
PARTITION_BYTES = 1 << 30
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(
    spark: SparkSession, input_bytes: int = 0, partition_bytes: int = PARTITION_BYTES
) -> SparkSession:
    """Turn on runtime skew handling and runtime filters and size shuffles for ``input_bytes``.

    A shuffle gets one partition per ``partition_bytes`` of input, and at least as many as
    the session asks for; there is no upper bound. The setting depends on the
    arguments alone, not on earlier calls. It is the session's and is read when a plan runs: of two results
    built first and run later, both get what the later call asked for.
    """
    for name, value in (SKEW_SETTINGS | RUNTIME_FILTERS).items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    partitions = math.ceil(input_bytes / partition_bytes)
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL_PARTITIONS, str(partitions))
    else:
        spark.conf.unset(INITIAL_PARTITIONS)
    return spark


def read_bytes(df: DataFrame) -> int:
    """Size of the tables ``df`` reads, as their file listings or catalog statistics say; runs no job.

    A table read twice counts twice; rows made by the query itself count nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    relations = (leaves.apply(i) for i in range(leaves.size()))
    return sum(
        int(r.stats().sizeInBytes())
        for r in relations
        if "Relation" in r.nodeName() and r.nodeName() not in ("LocalRelation", "OneRowRelation")
    )


def side_by_side(spark: SparkSession, *steps: Callable[[], list]) -> list[list]:
    """What the steps return, run at the same time: the tasks of one fill the cores that another leaves idle.

    All have ended when this returns or, if one fails, raises its error.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one the cluster names in ``spark.checkpoint.dir``.

    A session on this machine alone gets a temporary folder when that setting
    is missing; on a cluster every node must see the files, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder all nodes share")
        root = tempfile.mkdtemp(prefix="feira-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session_folder(spark: SparkSession, name: str) -> str:
    """A :func:`shared_folder` that goes when the driver ends, not before: results may be read from it until then."""
    root = shared_folder(spark, name)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(conf).delete(where, True)
        except (Py4JError, OSError):
            return  # the JVM has ended first

    atexit.register(drop)
    return root


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`shared_folder` named, with the file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
