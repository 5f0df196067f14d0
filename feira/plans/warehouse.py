"""Build, store and publish the three derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feira.config import Config
from feira.operators.bitmaps import distinct_bitmaps
from feira.operators.merge import changes_by_key, merged, touched_quarters
from feira.operators.tables import PERIOD_FOLDERS, publish, refresh_table
from feira.operators.versions import (
    Part,
    create_views,
    in_periods,
    latest,
    marks_by_quarter,
    next_generation,
    open_parts,
    parts_of,
    publish_parts,
    refresh_views,
    write_generation,
)
from feira.plans.curated import curate_customers, curate_purchases
from feira.plans.funnel import growth_funnel
from feira.session import drop_folder, side_by_side
from feira.sources.marketplace import SCHEMAS, Marketplace

PURCHASES, CUSTOMERS, FUNNEL = "analytics_compras", "analytics_clientes", "growth_funil"
MANIFEST, BUYERS = "analytics_versoes", "compradores_trimestre"


def store_purchases(m: Marketplace, root: str, cfg: Config) -> DataFrame:
    purchases = curate_purchases(m.pedidos, m.comercios, cfg)
    return refresh_table(purchases, f"{root}/{PURCHASES}", PERIOD_FOLDERS, "compra_id")


def store_customers(m: Marketplace, root: str, cfg: Config) -> DataFrame:
    customers = curate_customers(m.clientes, m.enderecos, m.segments, cfg)
    return refresh_table(customers, f"{root}/{CUSTOMERS}", PERIOD_FOLDERS, "cliente_id")


def store_funnel(m: Marketplace, root: str, cfg: Config) -> DataFrame:
    """Store the curated tables, then the funnel computed from them."""
    purchases = store_purchases(m, root, cfg)
    customers = store_customers(m, root, cfg)
    funnel = growth_funnel(m.analytics_app, customers, purchases, cfg)
    return refresh_table(funnel, f"{root}/{FUNNEL}")


def publish_tables(spark: SparkSession, root: str, cfg: Config) -> None:
    """Make the tables stored under ``root`` available to SQL by name, one view after the other."""
    for name, schema in table_schemas(spark, cfg).items():
        publish(spark, name, f"{root}/{name}", schema)


def build_version(m: Marketplace, root: str, cfg: Config) -> int:
    """Build the three tables anew and publish them as one version: readers get all of it or none.

    Nothing that is there is changed, so a build that fails, at whatever table, leaves readers where they are.
    """
    spark = m.pedidos.sparkSession
    version = latest(spark, root) + 1
    generation = next_generation(version)
    purchases = curate_purchases(m.pedidos, m.comercios, cfg)
    customers = curate_customers(m.clientes, m.enderecos, m.segments, cfg)
    bought, signed = side_by_side(
        spark,
        lambda: write_generation(purchases, root, PURCHASES, generation, "compra_id"),
        lambda: write_generation(customers, root, CUSTOMERS, generation, "cliente_id"),
    )
    return _with_funnel(m, root, cfg, version, generation, bought + signed)


def refresh_version(m: Marketplace, root: str, cfg: Config) -> int:
    """Publish a version that equals a full build, writing only the quarters that changed.

    Purchases are compared quarter by quarter by the sum of their rows' hashes, which shuffles a row per task and
    quarter, and only changed quarters are built again, with the period pushed to the scan. Customers are compared
    by key; the folders that lose, gain or change a row are merged from the stored rows and the changed ones.
    Where nothing changed but the traffic, only the funnel is new. Returns the latest version if nothing changed at all.
    """
    spark = m.pedidos.sparkSession
    last = latest(spark, root)
    if not last:
        return build_version(m, root, cfg)
    version, schemas = last + 1, table_schemas(spark, cfg)
    generation = next_generation(version)
    held = parts_of(spark, root, last)
    bought, signed = ([p for p in held if p.tabela == table] for table in (PURCHASES, CUSTOMERS))
    purchases, customers = side_by_side(
        spark,
        lambda: _changed_purchases(m, root, cfg, generation, bought),
        lambda: _changed_customers(m, root, cfg, generation, signed, schemas[CUSTOMERS]),
    )
    parts = purchases + customers
    if set(parts) == {p for p in held if p.tabela != FUNNEL}:
        old = open_parts(spark, root, FUNNEL, schemas[FUNNEL], held)
        if old.collect() == _funnel(m, root, cfg, parts).collect():  # a row each
            return last
    return _with_funnel(m, root, cfg, version, generation, parts)


def _changed_purchases(m: Marketplace, root: str, cfg: Config, generation: str, held: list[Part]) -> list[Part]:
    fresh = curate_purchases(m.pedidos, m.comercios, cfg)
    marks = marks_by_quarter(fresh)
    same = [p for p in held if marks.get(p.period) == (p.linhas, p.marca)]
    changed = set(marks) - {p.period for p in same}
    if not changed:
        return same
    return same + write_generation(in_periods(fresh, changed), root, PURCHASES, generation, "compra_id")


def _changed_customers(
    m: Marketplace, root: str, cfg: Config, generation: str, held: list[Part], schema: StructType
) -> list[Part]:
    spark = m.pedidos.sparkSession
    fresh = curate_customers(m.clientes, m.enderecos, m.segments, cfg)
    stored = open_parts(spark, root, CUSTOMERS, schema, held)
    path = f"{root}/.changes-{generation}"
    changes = refresh_table(changes_by_key(stored, fresh, "cliente_id"), path)
    try:
        touched = touched_quarters(changes)
        same = [p for p in held if p.period not in touched]
        if not touched:
            return same
        rows = merged(in_periods(stored, touched), changes, "cliente_id")
        return same + write_generation(rows, root, CUSTOMERS, generation, "cliente_id")
    finally:
        drop_folder(spark, path)


def _funnel(m: Marketplace, root: str, cfg: Config, parts: list[Part]) -> DataFrame:
    tables = _open(m.pedidos.sparkSession, root, cfg, parts)
    return growth_funnel(m.analytics_app, tables[CUSTOMERS], tables[PURCHASES], cfg)


def _with_funnel(m: Marketplace, root: str, cfg: Config, version: int, generation: str, parts: list[Part]) -> int:
    funnel = write_generation(_funnel(m, root, cfg, parts), root, FUNNEL, generation)
    return publish_parts(m.pedidos.sparkSession, root, version, parts + funnel)


def _open(spark: SparkSession, root: str, cfg: Config, parts: list[Part]) -> dict[str, DataFrame]:
    return {name: open_parts(spark, root, name, schema, parts) for name, schema in table_schemas(spark, cfg).items()}


def open_version(spark: SparkSession, root: str, cfg: Config, version: int | None = None) -> dict[str, DataFrame]:
    """The three tables of one version, the latest when not named; they stay that version whatever is published."""
    return _open(spark, root, cfg, parts_of(spark, root, latest(spark, root) if version is None else version))


def version_parts(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """What a version is made of: ``tabela, ano, trimestre, linhas`` per folder and the ``versao`` that wrote it."""
    number = latest(spark, root) if version is None else version
    rows = [(p.tabela, p.ano, p.trimestre, p.linhas, int(p.geracao[1:9])) for p in parts_of(spark, root, number)]
    return spark.createDataFrame(rows, "tabela string, ano int, trimestre int, linhas bigint, versao int")


def store_buyers(purchases: DataFrame, root: str) -> DataFrame:
    """Bitmaps of the buyers of valid orders, by quarter: any window's buyers without reading an order."""
    valid = purchases.where(F.col("status_pedido") == 1)
    bitmaps = distinct_bitmaps(valid, "cliente_id", PERIOD_FOLDERS)
    return refresh_table(bitmaps, f"{root}/{BUYERS}", PERIOD_FOLDERS)


def create_version_views(spark: SparkSession, root: str, cfg: Config) -> None:
    """SQL names for the three tables that follow what is published under ``root``; see :func:`publish_seen`."""
    create_views(spark, root, table_schemas(spark, cfg), MANIFEST)


def publish_seen(spark: SparkSession) -> None:
    """Take this session's views to the version published last, the three of them at once."""
    refresh_views(spark, MANIFEST)


def table_schemas(spark: SparkSession, cfg: Config) -> dict[str, StructType]:
    """The columns of the three tables, from their plans over empty sources."""
    m = Marketplace(lambda name: spark.createDataFrame([], SCHEMAS[name]))
    purchases = curate_purchases(m.pedidos, m.comercios, cfg)
    customers = curate_customers(m.clientes, m.enderecos, m.segments, cfg)
    funnel = growth_funnel(m.analytics_app, customers, purchases, cfg)
    return {PURCHASES: purchases.schema, CUSTOMERS: customers.schema, FUNNEL: funnel.schema}
