
from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from feira.config import Config  # noqa: E402
from feira.functions.dates import age_years  # noqa: E402
from feira.operators.checks import key_faults  # noqa: E402
from feira.operators.clustered import read_range, store_clustered  # noqa: E402
from feira.operators.period import in_quarter_tokens  # noqa: E402
from feira.operators.windows import report_windows, store_windows  # noqa: E402
from feira.plans import curated, funnel, purchases, signups, traffic, warehouse  # noqa: E402
from feira.session import read_bytes, session_folder, tune  # noqa: E402
from feira.sources.marketplace import Marketplace  # noqa: E402
from feira.sources.snapshot import from_report_snapshot, split_snapshot, to_report_snapshot  # noqa: E402
from feira.sources.star import STAR_CONFIG, from_star  # noqa: E402

# The text operators are optional: without their folder, or a library they need, the rest works as it is.
try:
    from feira.llm import queries as llm_queries
except ImportError as missing:
    warnings.warn(f"text operators left out: {missing}", stacklevel=1)
    llm_queries = None
try:
    import corpus_pipeline
except ImportError as missing:
    warnings.warn(f"corpus pipeline left out: {missing}", stacklevel=1)
    corpus_pipeline = None

CFG = STAR_CONFIG
BY_CLIENT = replace(STAR_CONFIG, dedup_key="client")
BOUGHT, SIGNED = ("pedidos", "comercios"), ("clientes", "enderecos")

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str) -> Marketplace:
    """The source tables of a folder, listed anew by each call, so that files added at any depth are seen."""
    return from_star(spark, sf_dir)


def _compras(m: Marketplace, cfg: Config = CFG) -> DataFrame:
    return curated.curate_purchases(m.pedidos, m.comercios, cfg)


def _clientes(m: Marketplace, cfg: Config = CFG) -> DataFrame:
    return curated.curate_customers(m.clientes, m.enderecos, m.segments, cfg)


def _on_source(build: Callable[[Marketplace], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(_tables(spark, sf_dir)).drop("time")  # repeats the columns derived from it
        tune(spark, read_bytes(df))
        return df

    return run


def _on_compras(report: Callable[..., DataFrame], **options) -> Query:
    return _on_source(lambda m: report(_compras(m), CFG, **options))


def _on_clientes(report: Callable[..., DataFrame], **options) -> Query:
    return _on_source(lambda m: report(_clientes(m), CFG, **options))


def _stored(store: Callable[[Marketplace, str], DataFrame], *tables: str) -> Query:
    """Store tables built from the named sources in a new folder, which lasts as long as the driver."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = _tables(spark, sf_dir)
        tune(spark, sum(read_bytes(getattr(m, t)) for t in tables))
        return store(m, session_folder(spark, "feira")).drop("time")

    return run


def _published(m: Marketplace, root: str) -> DataFrame:
    """Monthly value from the published purchases."""
    spark = m.pedidos.sparkSession
    warehouse.build_version(m, root, CFG)
    warehouse.create_version_views(spark, root, CFG)
    return purchases.gmv_monthly(spark.table(warehouse.PURCHASES), CFG)


def _earlier(m: Marketplace) -> Marketplace:
    """The sources before a third of one quarter's orders came and some clients got new phone numbers."""
    held_back = "id % 3 = 0 AND time >= TIMESTAMP_NTZ'2000-10-01' AND time < TIMESTAMP_NTZ'2001-01-01'"
    renumbered = F.expr("id % 40 = 0 AND time >= TIMESTAMP_NTZ'1995-01-01' AND time < TIMESTAMP_NTZ'1996-01-01'")

    def table(name: str) -> DataFrame:
        df = getattr(m, name)
        if name == "pedidos":
            return df.where(f"NOT coalesce({held_back}, false)")
        if name == "clientes":
            return df.withColumn("celular", F.when(renumbered, "antigo").otherwise(F.col("celular")))
        return df

    return Marketplace(table)


def _refreshed(read: Callable[[SparkSession, str], DataFrame]) -> Callable[[Marketplace, str], DataFrame]:
    """Publish a version from earlier sources, refresh it partially, and read the result."""

    def store(m: Marketplace, root: str) -> DataFrame:
        warehouse.build_version(_earlier(m), root, CFG)
        warehouse.refresh_version(m, root, CFG)
        return read(m.pedidos.sparkSession, root)

    return store


def _table_of_version(name: str, version: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: warehouse.open_version(spark, root, CFG, version)[name]


def _funnels(spark: SparkSession, root: str) -> DataFrame:
    """The funnel of both versions, read side by side."""
    old, new = (
        warehouse.open_version(spark, root, CFG, v)[warehouse.FUNNEL].withColumn("versao", F.lit(v)) for v in (1, 2)
    )
    return old.unionByName(new)


def _folders(spark: SparkSession, root: str) -> DataFrame:
    return warehouse.version_parts(spark, root).where(F.col("tabela") != warehouse.FUNNEL)


REPORTS = tuple(report_windows(CFG))


def _buyers_by_window(m: Marketplace, root: str) -> DataFrame:
    windows = store_windows(m.pedidos.sparkSession, report_windows(CFG), f"{root}/janelas")
    bitmaps = warehouse.store_buyers(_compras(m), root)
    return purchases.buyers_by_window(bitmaps, windows, REPORTS)


def _window_totals(m: Marketplace, root: str) -> DataFrame:
    windows = store_windows(m.pedidos.sparkSession, report_windows(CFG), f"{root}/janelas")
    return purchases.window_totals(warehouse.store_purchases(m, root, CFG), windows, REPORTS)


def _damaged(snapshot: DataFrame) -> DataFrame:
    """A purchase snapshot with days, quarters and amounts that cannot be."""
    number = F.col("compra_id").cast("bigint")
    return snapshot.withColumns(
        {
            "data_compra": F.when(number % 13 == 0, "31/02/2000").otherwise(F.col("data_compra")),
            "quarter": F.when(number % 17 == 0, "5/2000").otherwise(F.col("quarter")),
            "valor": F.when(number % 19 == 0, "doze").otherwise(F.col("valor")),
        }
    )


def _split_snapshot(m: Marketplace, root: str) -> tuple[DataFrame, DataFrame]:
    return split_snapshot(_damaged(to_report_snapshot(_compras(m))), f"{root}/snapshot", Observation())


def _faulty_sellers(m: Marketplace) -> DataFrame:
    """Sellers of whom some repeat under another name and some are missing."""
    kept = m.comercios.where("id % 11 <> 0")
    again = m.comercios.where("id % 7 = 0").withColumn("nome_fantasia", F.concat(F.lit("ZZ "), "nome_fantasia"))
    return kept.unionByName(again)


def _checked_purchases(m: Marketplace) -> DataFrame:
    return curated.curate_purchases_checked(m.pedidos, _faulty_sellers(m), CFG, Observation())


def _clients_of_a_range(m: Marketplace, root: str) -> DataFrame:
    """Orders of the clients 100 to 200, from a table clustered by client."""
    compras = _compras(m).select("cliente_id", "compra_id", "valor", "data_compra", "status_pedido")
    store_clustered(compras, f"{root}/por_cliente", "cliente_id", "compra_id")
    return read_range(m.pedidos.sparkSession, f"{root}/por_cliente", compras.schema, "cliente_id", 100, 200)[0]


def _account_years(m: Marketplace) -> DataFrame:
    """Completed years since each client's registration."""
    return m.clientes.select(
        F.col("id").alias("cliente_id"), age_years(F.col("time"), CFG.as_of).alias("anos")
    )


def _snapshot(curated_table: DataFrame) -> DataFrame:
    return from_report_snapshot(to_report_snapshot(curated_table))


def _literal_quarter_filter(m: Marketplace) -> DataFrame:
    """Valid orders matched by each spelling of the quarter tokens."""
    valid = _compras(m).where(F.col("status_pedido") == 1)
    matched = {
        name: in_quarter_tokens(f"{q}{sep}{year}" for year, q in CFG.windows.purchases)
        for name, sep in (("pedidos_token_barra", "/"), ("pedidos_token_hifen", "-"))
    }
    return valid.agg(
        F.count("compra_id").alias("pedidos"),
        *(F.count(F.when(hit, F.col("compra_id"))).alias(name) for name, hit in matched.items()),
    )


def report_queries() -> dict[str, Query]:
    """The queries on marketplace tables."""
    return {
        # curated tables
        "curated_purchases": _on_source(_compras),
        "curated_customers": _on_source(_clientes),
        "curated_customers_by_client": _on_source(lambda m: _clientes(m, BY_CLIENT)),
        "customer_segments": _on_source(
            lambda m: curated.customer_segments(m.clientes, m.segments, CFG)
        ),
        "customer_purchases": _on_source(
            lambda m: curated.customer_purchases(_clientes(m), _compras(m))
        ),
        "customer_purchases_by_client": _on_source(
            lambda m: curated.customer_purchases(_clientes(m, BY_CLIENT), _compras(m))
        ),
        # app traffic
        "app_daily": _on_source(lambda m: m.analytics_app),
        "db_app": _on_source(lambda m: m.db_app),
        "app_totals": _on_source(lambda m: traffic.app_totals(m.analytics_app)),
        "app_monthly": _on_source(lambda m: traffic.app_monthly(m.analytics_app)),
        # registrations
        "account_years": _on_source(_account_years),
        "signups_total": _on_clientes(signups.signups_total),
        "active_signups_total": _on_clientes(signups.active_signups_total),
        "active_signups_monthly": _on_clientes(signups.active_signups_monthly),
        "active_signups_calendar": _on_clientes(signups.active_signups_monthly, keep_month=True),
        "active_clients_by_segment": _on_clientes(signups.active_clients_by_segment),
        "signups_by_segment": _on_clientes(signups.signups_by_segment),
        "signups_by_cep": _on_clientes(signups.signups_by_cep),
        "signups_by_bairro": _on_clientes(signups.signups_by_bairro),
        "signups_by_cidade": _on_clientes(signups.signups_by_cidade),
        "signups_by_estado": _on_clientes(signups.signups_by_estado),
        # purchases and sellers
        "gmv_monthly": _on_compras(purchases.gmv_monthly),
        "gmv_calendar": _on_compras(purchases.gmv_monthly, keep_month=True),
        "orders_monthly": _on_compras(purchases.orders_monthly),
        "orders_monthly_pedidos_mes": _on_compras(purchases.orders_monthly, name="pedidos_mes"),
        "orders_total": _on_compras(purchases.orders_total),
        "buyers_total": _on_compras(purchases.buyers_total),
        "orders_per_client": _on_compras(purchases.orders_per_client),
        "spend_per_client": _on_compras(purchases.spend_per_client),
        "client_recency": _on_compras(purchases.client_recency),
        "client_recency_by_name": _on_compras(purchases.client_recency_by_name),
        "last_purchase_per_client": _on_compras(purchases.last_purchase_per_client),
        "seller_sales": _on_compras(purchases.seller_sales),
        "seller_month": _on_compras(purchases.seller_month),
        "seller_month_literal": _on_compras(purchases.seller_month_literal),
        "literal_quarter_filter": _on_source(_literal_quarter_filter),
        # funnel
        "growth_funnel": _on_source(
            lambda m: funnel.growth_funnel(m.analytics_app, _clientes(m), _compras(m), CFG)
        ),
        # text snapshots and stored tables
        "snapshot_roundtrip": _on_source(lambda m: _snapshot(_compras(m))),
        "customer_snapshot_roundtrip": _on_source(lambda m: _snapshot(_clientes(m))),
        "snapshot_gmv_monthly": _on_source(
            lambda m: purchases.gmv_monthly(_snapshot(_compras(m)), CFG)
        ),
        "snapshot_active_signups_monthly": _on_source(
            lambda m: signups.active_signups_monthly(_snapshot(_clientes(m)), CFG)
        ),
        "stored_purchases": _stored(
            lambda m, root: warehouse.store_purchases(m, root, CFG), *BOUGHT
        ),
        "stored_customers": _stored(
            lambda m, root: warehouse.store_customers(m, root, CFG), *SIGNED
        ),
        "stored_gmv_monthly": _stored(
            lambda m, root: purchases.gmv_monthly(warehouse.store_purchases(m, root, CFG), CFG),
            *BOUGHT,
        ),
        "stored_growth_funnel": _stored(
            lambda m, root: warehouse.store_funnel(m, root, CFG), *BOUGHT, *SIGNED, "analytics_app"
        ),
        "published_gmv_monthly": _stored(_published, *BOUGHT, *SIGNED, "analytics_app"),
        # versions: published as one, refreshed in part
        "refreshed_purchases": _stored(_refreshed(_table_of_version(warehouse.PURCHASES)), *BOUGHT, *SIGNED),
        "refreshed_customers": _stored(_refreshed(_table_of_version(warehouse.CUSTOMERS)), *BOUGHT, *SIGNED),
        "refreshed_folders": _stored(_refreshed(_folders), *BOUGHT, *SIGNED),
        "published_funnels": _stored(_refreshed(_funnels), *BOUGHT, *SIGNED, "analytics_app"),
        # several windows or groupings in one plan
        "buyers_by_window": _stored(_buyers_by_window, *BOUGHT),
        "window_totals": _stored(_window_totals, *BOUGHT),
        "signups_breakdowns": _on_clientes(signups.signups_breakdowns),
        "purchases_rollup": _on_compras(purchases.purchases_rollup),
        # faults in what is read
        "snapshot_rejects": _stored(
            lambda m, root: _split_snapshot(m, root)[1].select("compra_id", "data_compra", "quarter", "valor", "motivo"), *BOUGHT
        ),
        "snapshot_kept_gmv": _stored(
            lambda m, root: purchases.gmv_monthly(_split_snapshot(m, root)[0], CFG), *BOUGHT
        ),
        "checked_purchases": _on_source(_checked_purchases),
        "key_faults": _on_source(
            lambda m: key_faults(m.pedidos, _faulty_sellers(m), "comercio_id", "id", "pedidos", "comercios")
        ),
        # clustered storage
        "clustered_client_orders": _stored(_clients_of_a_range, *BOUGHT),
    }


def queries() -> dict[str, Query]:
    return report_queries() | (llm_queries.queries() if llm_queries else {}) | (
        {"pipeline": corpus_pipeline.run} if corpus_pipeline else {}
    )


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql() | (llm_queries.oracle_sql() if llm_queries else {}) | (
        {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {}
    )


def entry(spark: SparkSession) -> DataFrame:
    """Monthly merchandise value of valid orders at sf0.001."""
    return queries()["gmv_monthly"](spark, "/root/testdata/sf0.001")
