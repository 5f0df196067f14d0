"""The marketplace tables derived from a TPC-H-like star schema and an event log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.config import Config, Windows, quarters_of
from feira.sources.marketplace import Marketplace

# fixed values: the periods in which the star schema has data
STAR_CONFIG = Config(
    as_of=date(2001, 8, 1),
    windows=Windows(
        signups=quarters_of(1995),
        purchases=quarters_of(2000) + ((2001, 1),),
        funnel_buyers=quarters_of(2000),
        funnel_last_quarter=((2000, 4),),
    ),
)


# The columns the mapping reads. Given types spare Spark opening a file footer per table.
SCHEMAS = {
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint, l_suppkey bigint",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def from_star(spark: SparkSession, root: str) -> Marketplace:
    """The marketplace tables over ``root/<star table>.parquet``, listed anew by each call."""

    def star(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")

    builders = {
        "pedidos": lambda: _pedidos(star("orders"), star("lineitem"), star("customer")),
        "comercios": lambda: _comercios(star("supplier")),
        "clientes": lambda: _clientes(star("customer"), star("orders")),
        "enderecos": lambda: _enderecos(
            star("orders"), star("customer"), star("nation"), star("region")
        ),
        "analytics_app": lambda: _analytics_app(star("events")),
        "segments": lambda: _segments(spark),
        "db_app": lambda: star("events"),
    }
    return Marketplace(lambda name: builders[name]())


def _comercios(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey AS id",
        "s_name || IF(s_suppkey % 10 = 0, ' - Test', '') AS nome_fantasia",
    )


def _pedidos(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """One seller per order; the order's name is the customer's, in two spellings.

    Sellers and names have one row per key, so a report that does not read
    them drops the join and the scan behind it. The rebalanced names do not count as
    laid out by customer already, so AQE can split the orders of a hot customer.
    """
    sellers = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("comercio_id"))
    names = customer.groupBy("c_custkey").agg(F.min("c_name").alias("c_name")).hint("rebalance")
    sold = orders.join(sellers, orders["o_orderkey"] == sellers["l_orderkey"], "left")
    named = sold.join(names, orders["o_custkey"] == names["c_custkey"], "left")
    return named.selectExpr(
        "o_orderkey AS id",
        "o_custkey AS cliente_id",
        "c_name || IF(o_orderkey % 10 = 0, ' B', '') AS nome",
        "'Customer' || o_custkey || '@Example.com' AS email",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS valor",
        "CAST(o_orderkey % 50 AS DECIMAL(12,2)) AS frete",
        "comercio_id",
        """CASE WHEN o_orderkey % 41 = 0 THEN NULL
                WHEN o_orderstatus = 'P' THEN 'Cancelado'
                WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'Pagamento recusado'
                ELSE 'Entregue' END AS status""",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) AS time",
    )


def _clientes(customer: DataFrame, orders: DataFrame) -> DataFrame:
    since = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    return customer.join(since, customer["c_custkey"] == since["o_custkey"], "left").selectExpr(
        "c_custkey AS id",
        "'Nome' || c_custkey % 20 AS nome",
        "IF(c_custkey % 31 = 0, NULL, c_mktsegment) AS sobrenome",
        """CASE WHEN c_custkey % 50 = 0 THEN 'deleted'
                WHEN c_custkey % 101 = 0 THEN NULL
                ELSE 'Customer' || c_custkey || '@Example.com' END AS email""",
        "'11-9' || lpad(CAST(c_custkey AS STRING), 9, '0') || '-0' AS celular",
        "IF(c_custkey % 3 = 0, NULL, CAST(c_custkey AS STRING)) AS cpf",
        "IF(c_custkey % 3 = 0, c_custkey || '/0001', NULL) AS cnpj",
        "IF(c_custkey % 3 = 0, 'J', 'F') AS tipo_pessoa",
        "IF(c_acctbal < 0, 'Inativo', 'Ativo') AS status",
        "CAST(since AS TIMESTAMP_NTZ) AS time",
    )


def _enderecos(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """One address per order, for six customers in seven."""
    # 25 nations in 5 regions, fixed by the schema: small enough to broadcast at any scale
    places = F.broadcast(
        nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    )
    owned = orders.where("o_custkey % 7 <> 0").join(
        customer, orders["o_custkey"] == customer["c_custkey"], "left"
    )
    place_key = (owned["c_nationkey"] + owned["o_orderkey"]) % 25
    return owned.join(places, place_key == places["n_nationkey"], "left").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS cliente_id",
        "CAST(o_orderkey % 97 AS STRING) AS cep",
        "o_orderpriority AS bairro",
        "IF(o_orderkey % 29 = 0, NULL, n_name) AS cidade",
        "IF(o_orderkey % 37 = 0, '1', r_name) AS estado",
    )


def _analytics_app(events: DataFrame) -> DataFrame:
    dated = events.selectExpr(
        """IF(user_id % 50 = 0, NULL,
              date_add(CAST(ts AS DATE), CAST(user_id % 12 * 30 AS INT))) AS data""",
        "event_type",
    )
    return dated.groupBy("data").agg(
        F.expr("count_if(event_type = 'view')").alias("total_visitas"),
        F.expr("count_if(event_type = 'signup')").alias("total_downloads"),
    )


def _segments(spark: SparkSession) -> DataFrame:
    # fixed values: the e-mail lists
    return spark.sql(
        """SELECT * FROM VALUES
             ('customer1@example.com', 'ATACADO'),
             ('customer2@example.com', 'ATACADO'),
             ('customer4@example.com', 'ATACADO'),
             ('customer5@example.com', 'MINIMARKET'),
             ('customer6@example.com', 'MINIMARKET')
           AS segments(email, segment)"""
    )
