"""Versions of a set of stored tables, to which readers change all at once.

A refresh writes folders of its own and changes no file that is there. A manifest per version names the folders
that make up each table; adding the next manifest, one file under its final name, is the switch for all
tables. A refresh that fails before it leaves nothing that a reader looks at. A version may name folders of earlier
ones, so what did not change is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feira.operators.period import in_quarters, in_quarters_expr
from feira.operators.tables import PERIOD_FOLDERS, laid_out

#: The folder level that tells the refreshes of a table apart, and the name of the manifest as a SQL table.
GENERATION = "geracao"
MANIFEST_FIELDS = "versao int, tabela string, geracao string, ano int, trimestre int, linhas bigint, marca string"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"

Period = tuple[int | None, int | None]


@dataclass(frozen=True)
class Part:
    """A folder of a table: one quarter of one generation, or, of a table without quarters, the generation."""

    tabela: str
    geracao: str
    ano: int | None = None
    trimestre: int | None = None
    linhas: int = 0
    marca: str | None = None

    @property
    def period(self) -> Period:
        return self.ano, self.trimestre

    def path(self, root: str, folders: Sequence[str]) -> str:
        levels = "".join(f"/{f}={NULL_FOLDER if v is None else v}" for f, v in zip(folders, self.period))
        return f"{root}/{self.tabela}/{GENERATION}={self.geracao}{levels}"


def folders_of(schema: StructType) -> tuple[str, ...]:
    """The folder columns of a table: the quarter, if it has one."""
    return PERIOD_FOLDERS if set(PERIOD_FOLDERS) <= set(schema.names) else ()


def next_generation(version: int) -> str:
    return f"g{version:08d}-{uuid.uuid4().hex[:12]}"


def row_marks(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row; summed, they mark a set of rows whatever its order, repeated rows included."""
    return [F.xxhash64(F.lit(lane), *columns) for lane in (0, 1)]


#: A hash is summed in pieces of this many bits, each a bigint that holds 2^41 rows; sums as decimals take longer.
PIECE_BITS = 22


def _piece_sums(mark: str) -> list[Column]:
    """The sums of the low, middle and high piece of a hash, of which the high one has its sign."""
    low = f"{(1 << PIECE_BITS) - 1}L"
    pieces = (f"{mark} & {low}", f"shiftright({mark}, {PIECE_BITS}) & {low}", f"shiftright({mark}, {2 * PIECE_BITS})")
    return [F.sum(F.expr(p)).alias(f"{mark}_{i}") for i, p in enumerate(pieces)]


def marks_by_quarter(df: DataFrame) -> dict[Period, tuple[int, str]]:
    """Number of rows and mark of each quarter: a row per quarter comes to the driver.

    The sums combine before the shuffle, so a quarter that holds most rows is no hot key.
    """
    lanes = ("um", "dois")
    hashed = df.select(*PERIOD_FOLDERS, *(h.alias(lane) for h, lane in zip(row_marks(sorted(df.columns)), lanes)))
    sums = hashed.groupBy(*PERIOD_FOLDERS).agg(
        F.count(F.lit(1)).alias("n"), *(s for lane in lanes for s in _piece_sums(lane))
    )

    def total(row: Row, lane: str) -> int:
        return sum(row[f"{lane}_{i}"] << (i * PIECE_BITS) for i in range(3))

    return {(r.ano, r.trimestre): (r.n, ":".join(str(total(r, lane)) for lane in lanes)) for r in sums.collect()}


def in_periods(df: DataFrame, periods: Iterable[Period]) -> DataFrame:
    """Rows of the quarters, of which one may be that of rows without a time."""
    real = [p for p in periods if None not in p]
    if len(real) == len(set(periods)):
        return in_quarters(df, real)
    return df.where(in_quarters_expr(real) | F.col(PERIOD_FOLDERS[0]).isNull())


def write_generation(
    df: DataFrame, root: str, table: str, generation: str, newest_first: str | None = None
) -> list[Part]:
    """Store ``df`` as folders of a new generation; the parts carry the rows and marks of what was written."""
    folders = folders_of(df.schema)
    path = f"{root}/{table}/{GENERATION}={generation}"
    laid_out(df, folders, newest_first).write.mode("errorifexists").partitionBy(*folders).parquet(path)
    if not folders:
        return [Part(table, generation)]
    written = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    marks = marks_by_quarter(written)
    return [Part(table, generation, *period, n, mark) for period, (n, mark) in sorted(marks.items(), key=str)]


def open_parts(spark: SparkSession, root: str, table: str, schema: StructType, parts: Iterable[Part]) -> DataFrame:
    """The table made of ``parts``; its quarters are folder columns, by which reports prune."""
    folders = folders_of(schema)
    paths = [p.path(root, folders) for p in parts if p.tabela == table]
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{root}/{table}")
    return reader.parquet(*paths).select(*schema.names)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, system = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions published under ``root``, oldest first."""
    names = (n.removesuffix(".json") for n in _names(spark, f"{root}/manifest"))
    return sorted(int(n) for n in names if n.isdigit())


def latest(spark: SparkSession, root: str) -> int:
    """The version that readers get now; 0 before the first."""
    return max(versions(spark, root), default=0)


def parts_of(spark: SparkSession, root: str, version: int) -> list[Part]:
    """What a version is made of: a row per folder comes to the driver."""
    if not version:
        return []
    rows = spark.read.schema(MANIFEST_FIELDS).json(f"{root}/manifest/{version:08d}.json").drop("versao").collect()
    return [Part(**r.asDict()) for r in rows if r.tabela is not None]


def publish_parts(spark: SparkSession, root: str, version: int, parts: Iterable[Part]) -> int:
    """Make ``parts`` the version, in one step.

    The manifest is written under a name that no reader looks at and renamed. If another refresh has
    published that version meanwhile, this one fails and changes nothing.
    """
    lines = [json.dumps({"versao": version, **asdict(p)}) for p in parts] or [json.dumps({"versao": version})]
    final, system = _file_system(spark, f"{root}/manifest/{version:08d}.json")
    hidden, _ = _file_system(spark, f"{root}/manifest/.{version:08d}-{uuid.uuid4().hex}")
    out = system.create(hidden, False)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(),
        spark.sparkContext._jsc.hadoopConfiguration(),
    )
    replace_nothing = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context.rename(system.makeQualified(hidden), system.makeQualified(final), replace_nothing)
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drop all but the last ``keep`` versions and the folders that none of these names; the paths that went.

    Generations of a refresh that is under way are newer than the latest version and stay.
    """
    published = versions(spark, root)
    kept = published[-max(keep, 1) :]
    if not kept:
        return []
    used = {(p.tabela, p.geracao) for v in kept for p in parts_of(spark, root, v)}
    gone = [f"{root}/manifest/{v:08d}.json" for v in published[: len(published) - len(kept)]]
    for table in sorted(n for n in _names(spark, root) if n != "manifest" and not n.startswith((".", "_"))):
        for name in _names(spark, f"{root}/{table}"):
            generation = name.removeprefix(f"{GENERATION}=")
            made_for = int(generation[1:9])  # version 0: the file that holds the columns
            if 0 < made_for <= kept[-1] and (table, generation) not in used:
                gone.append(f"{root}/{table}/{name}")
    for path in gone:
        where, system = _file_system(spark, path)
        system.delete(where, True)
    return gone


def create_views(spark: SparkSession, root: str, schemas: Mapping[str, StructType], manifest: str) -> None:
    """SQL names for the tables: views that look up the latest version in ``manifest``, a table over the manifests.

    The views are made once; publishing does not touch them. A session keeps the manifest it has read until
    ``REFRESH TABLE`` of it, which takes all its views to the latest version at once. In a view the manifest is
    looked up before the files are listed, so what it names is there.
    """
    spark.sql(f"DROP TABLE IF EXISTS {manifest}")  # the name only: the manifests stay
    spark.sql(f"CREATE TABLE {manifest} ({MANIFEST_FIELDS}) USING json LOCATION '{root}/manifest'")
    for table, schema in schemas.items():
        _with_schema_file(spark, root, table, schema)
        folders = folders_of(schema)
        wanted = ", ".join([f"{GENERATION} AS em_{GENERATION}", *(f"{f} AS em_{f}" for f in folders)])
        same = " AND ".join([f"{GENERATION} = em_{GENERATION}", *(f"{f} <=> em_{f}" for f in folders)])
        columns = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields)
        spark.sql(
            f"""CREATE OR REPLACE VIEW {table} AS SELECT {columns}
            FROM (SELECT {wanted} FROM {manifest}
                  WHERE tabela = '{table}' AND versao = (SELECT max(versao) FROM {manifest}))
            JOIN parquet.`{root}/{table}` ON {same}"""
        )
    refresh_views(spark, manifest)


def refresh_views(spark: SparkSession, manifest: str) -> None:
    """Take this session's views to the latest version, all at once."""
    spark.sql(f"REFRESH TABLE {manifest}")


def _with_schema_file(spark: SparkSession, root: str, table: str, schema: StructType) -> None:
    """A folder with one file without rows, from which a view over an empty table takes its columns."""
    folders = folders_of(schema)
    path = f"{root}/{table}/{GENERATION}=g00000000{''.join(f'/{f}=0' for f in folders)}"
    if not _names(spark, path):
        spark.createDataFrame([], schema).drop(*folders).coalesce(1).write.mode("overwrite").parquet(path)
