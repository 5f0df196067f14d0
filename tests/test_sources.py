import tempfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feira.config import Config
from feira.operators.tables import create_table, publish, refresh_table
from feira.plans import purchases, warehouse
from feira.plans.curated import curate_customers, curate_purchases
from feira.session import shared_folder
from feira.sources import snapshot
from feira.sources.marketplace import SCHEMAS, Marketplace, from_catalog, from_files
from tables import app, cliente, clientes, comercios, enderecos, pedidos, rows, segments

CFG = Config(as_of=date(2023, 5, 1))


def _tables(spark):
    return {
        "pedidos": pedidos(
            spark,
            (1, 1, "Ana", "10.10", 1, None, datetime(2022, 1, 5)),
            (2, 1, "Ana, a \"boa\"", "20.20", None, "", datetime(2022, 12, 5)),
            (3, 2, None, "5.00", 1, "Cancelado", None),
        ),
        "comercios": comercios(spark, (1, "Um")),
        "clientes": clientes(spark, cliente(1), cliente(2, nome="Bia", time=None)),
        "enderecos": enderecos(spark, (1, 1, "x")),
        "analytics_app": app(spark, (date(2022, 1, 1), 3, 1)),
        "segments": segments(spark, ("ana@mail.com", "MINIMARKET")),
        "db_app": spark.createDataFrame([("x",), ("y",)], "anything string"),
    }


@pytest.fixture(scope="module")
def market(spark):
    tables = _tables(spark)
    return Marketplace(tables.__getitem__)


@pytest.mark.parametrize(
    "fmt, options",
    [("parquet", {}), ("orc", {}), ("json", {}),
     ("csv", {"header": "true", "nullValue": "\\N"})],
)
def test_file_formats(spark, tmp_path, market, fmt, options):
    for name in SCHEMAS:
        getattr(market, name).write.format(fmt).options(**options).save(f"{tmp_path}/{name}")
    read = from_files(spark, str(tmp_path), fmt, **options)
    for name in SCHEMAS:
        assert getattr(read, name).schema == getattr(market, name).schema
        assert sorted(rows(getattr(read, name)), key=str) == sorted(
            rows(getattr(market, name)), key=str
        )


def test_catalog_tables(spark, market):
    for name in SCHEMAS:
        getattr(market, name).createOrReplaceTempView(name)
    assert from_catalog(spark).pedidos.count() == 3
    assert rows(from_catalog(spark).db_app) == [("x",), ("y",)]
    with pytest.raises(AttributeError):
        from_catalog(spark).fornecedores
    for name in SCHEMAS:
        spark.catalog.dropTempView(name)


def _curated(market):
    return (
        curate_purchases(market.pedidos, market.comercios, CFG),
        curate_customers(market.clientes, market.enderecos, market.segments, CFG),
    )


def test_snapshot_text_form(market):
    compras, _ = _curated(market)
    text = snapshot.to_report_snapshot(compras).orderBy("compra_id")
    assert {t for _, t in text.dtypes} == {"string"}
    got = text.select("compra_id", "valor", "status_pedido", "data_compra", "quarter")
    assert rows(got) == [
        ("1", "10.10", "1", "05/01/2022", "1/2022"),
        ("2", "20.20", "1", "05/12/2022", "4/2022"),
        ("3", "5.00", "0", None, None),
    ]


@pytest.mark.parametrize("at", [0, 1], ids=["purchases", "customers"])
def test_snapshot_round_trip(tmp_path, market, at):
    curated = _curated(market)[at]
    # the text form keeps days, not the time of day
    curated = curated.drop("time")
    back = snapshot.from_report_snapshot(snapshot.to_report_snapshot(curated))
    assert back.dtypes == curated.dtypes
    assert sorted(rows(back), key=str) == sorted(rows(curated), key=str)
    stored = refresh_table(snapshot.to_report_snapshot(curated), str(tmp_path / "s"))
    assert {t for _, t in stored.dtypes} == {"string"}
    assert sorted(rows(snapshot.from_report_snapshot(stored)), key=str) == sorted(
        rows(curated), key=str
    )


def test_snapshot_with_unreadable_text(spark):
    text = spark.createDataFrame(
        [("7", "x", "1", "1/5/2022", "2/2022"), ("y", "3.5", None, "31/02/2022", "junk")],
        "compra_id string, valor string, status_pedido string, data_compra string, quarter string",
    )
    got = snapshot.from_report_snapshot(text)
    assert rows(got) == [
        (7, None, 1, "2022-05-01", "2-2022", date(2022, 5, 1), date(2022, 5, 1), 2022, 2),
        (None, Decimal("3.50"), None, None, None, None, None, None, None),
    ]


def test_reports_accept_a_snapshot(market):
    compras, _ = _curated(market)
    back = snapshot.from_report_snapshot(snapshot.to_report_snapshot(compras))
    assert sorted(rows(purchases.gmv_monthly(back, CFG))) == sorted(
        rows(purchases.gmv_monthly(compras, CFG))
    )


def test_quarter_text_decides_the_period(spark):
    text = spark.createDataFrame(
        [("1", "9", "Ana", "a@b.c", "10.00", "Um", "1", "31/02/2022", "1/2022"),
         ("2", "9", "Ana", "a@b.c", "5.00", "Um", "1", "03/02/2022", "1/2022"),
         ("3", "8", "Bia", "b@b.c", "7.00", "Um", "1", "03/02/2022", None),
         ("4", "9", "Ana", "a@b.c", "1.00", "Um", "1", "01/07/2021", "2/2022")],
        "compra_id string, cliente_id string, nome string, email string, valor string, "
        "nome_fantasia string, status_pedido string, data_compra string, quarter string",
    )
    compras = snapshot.from_report_snapshot(text)
    assert sorted(rows(purchases.gmv_monthly(compras, CFG)), key=str) == [
        ("02-2022", Decimal("5.00")), ("07-2021", Decimal("1.00")), (None, Decimal("10.00")),
    ]
    assert rows(purchases.orders_total(compras, CFG)) == [(3,)]
    assert rows(purchases.seller_month_literal(compras, CFG)) == [("07-2021", "Um", 2)]
    assert rows(purchases.client_recency(compras, CFG)) == [
        (9, "Ana", "a@b.c", date(2022, 2, 3), 452)
    ]


def test_refresh_replaces(spark, tmp_path, market):
    compras, _ = _curated(market)
    path = str(tmp_path / "t")
    refresh_table(compras.limit(1), path, ("ano", "trimestre"), "compra_id")
    again = refresh_table(compras, path, ("ano", "trimestre"), "compra_id")
    assert again.columns == compras.columns
    assert sorted(rows(again), key=str) == sorted(rows(compras), key=str)


def test_catalog_table_is_recreated(spark, market):
    compras, _ = _curated(market)
    create_table(compras.select("compra_id"), "compras_teste")
    again = create_table(compras, "compras_teste", ("ano", "trimestre"), "compra_id")
    assert sorted(rows(again), key=str) == sorted(rows(compras), key=str)
    assert spark.sql("SELECT count(*) FROM compras_teste WHERE ano = 2022").first()[0] == 2
    spark.sql("DROP TABLE compras_teste")


def test_catalog_types_are_enforced(spark, market):
    loose = market.pedidos.withColumn("valor", F.col("valor").cast("double")).withColumn(
        "id", F.col("id").cast("string")
    )
    loose.createOrReplaceTempView("pedidos")
    read = from_catalog(spark).pedidos
    assert read.schema.simpleString() == StructType.fromDDL(SCHEMAS["pedidos"]).simpleString()
    assert sorted(rows(read), key=str) == sorted(rows(market.pedidos), key=str)


def test_refresh_replaces_whatever_the_session_says(spark, tmp_path, market):
    compras, _ = _curated(market)
    mode = "spark.sql.sources.partitionOverwriteMode"
    spark.conf.set(mode, "dynamic")
    try:
        refresh_table(compras, str(tmp_path / "t"), ("ano", "trimestre"))
        again = refresh_table(compras.where("compra_id = 1"), str(tmp_path / "t"), ("ano", "trimestre"))
        assert again.count() == 1
        create_table(compras, "trocada", ("ano", "trimestre"))
        assert create_table(compras.where("compra_id = 1"), "trocada", ("ano", "trimestre")).count() == 1
    finally:
        spark.conf.unset(mode)
        spark.sql("DROP TABLE IF EXISTS trocada")


def test_empty_tables_are_published(spark, tmp_path, market):
    compras, _ = _curated(market)
    refresh_table(compras.where("false"), str(tmp_path / "t"), ("ano", "trimestre"))
    publish(spark, "vazia", str(tmp_path / "t"), compras.schema)
    assert spark.table("vazia").schema.simpleString() == compras.schema.simpleString()
    assert spark.table("vazia").count() == 0
    spark.sql("DROP VIEW vazia")


def test_publish_swaps_versions(spark, tmp_path, market):
    compras, _ = _curated(market)
    refresh_table(compras.where("compra_id = 1"), str(tmp_path / "v1"))
    refresh_table(compras, str(tmp_path / "v2"))
    publish(spark, "analytics_compras", str(tmp_path / "v1"), compras.schema)
    reader = spark.table("analytics_compras")
    publish(spark, "analytics_compras", str(tmp_path / "v2"), compras.schema)
    assert (reader.count(), spark.table("analytics_compras").count()) == (1, 3)
    spark.sql("DROP VIEW analytics_compras")


def test_warehouse(spark, tmp_path, market):
    funnel = warehouse.store_funnel(market, str(tmp_path), CFG)
    assert rows(funnel) == [(3, 1, 1, 1, 1, 1)]
    warehouse.publish_tables(spark, str(tmp_path), CFG)
    spent = spark.sql(
        """SELECT ano, trimestre, sum(valor) AS gasto, min(data_compra) AS primeira
           FROM analytics_compras WHERE status_pedido = 1 GROUP BY ALL ORDER BY ALL"""
    )
    assert rows(spent) == [
        (2022, 1, Decimal("10.10"), "2022-01-05"), (2022, 4, Decimal("20.20"), "2022-12-05"),
    ]
    people = spark.sql(
        """SELECT cliente_id, purchase_type, cep, row_num FROM analytics_clientes
           ORDER BY cliente_id"""
    )
    assert rows(people) == [(1, "MINIMARKET", "x", 1), (2, "MINIMARKET", None, 1)]
    assert spark.table("growth_funil").columns == funnel.columns
    for name in (warehouse.PURCHASES, warehouse.CUSTOMERS, warehouse.FUNNEL):
        spark.sql(f"DROP VIEW {name}")


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_folder(spark, "t"), shared_folder(spark, "t")
    assert first != second
    assert first.startswith(f"{root.rstrip('/')}/t-" if root else tempfile.gettempdir())


def test_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "yarn"

    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        Cluster.sparkContext.master = master
        with pytest.raises(ValueError):
            shared_folder(Cluster, "t")
