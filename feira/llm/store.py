"""Folders all nodes share, tables kept between jobs, and the code that tasks import."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import files

#: Stands for a null id wherever rows are ordered or joined by id: nulls come first.
NULL_ID = -(2**63)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, from the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    out = files.Output(scratch(spark, "code", lasting=True), ".zip")
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(out.uri)
    _shipped.add(app)


def scratch(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new folder under the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on this machine alone, as in tests, may leave that unset.
    Results may be read from it as long as the driver lives; when it ends, the folder goes, or at the end of the
    :func:`temporary` block around the call, unless it is ``lasting``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder all nodes share")
        root = Path(tempfile.mkdtemp(prefix="feira-llm-")).as_uri()
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _held and not lasting:
        _held[-1].append(folder)
    else:
        atexit.register(files.drop, folder)
    return folder


#: Folders made inside each :func:`temporary` block that is open, the innermost last.
_held: list[list[str]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Scratch folders made inside go at its end: for a driver that calls operators often and stores their results inside."""
    _held.append([])
    try:
        yield
    finally:
        for folder in _held.pop():
            files.drop(folder)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table under ``path`` and read it back, which cuts its lineage.

    The files are complete or absent for each task, so a lost executor costs
    only the tasks it was running.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand Python at most ``rows`` rows at a time; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def row_id(column: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))
