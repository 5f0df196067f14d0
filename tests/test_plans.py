"""What the physical plans must and must not contain."""

import re
from dataclasses import replace
from pathlib import Path

import pytest

import __spark_entry__ as contract
import oracle_queries
from tables import TESTDATA
from feira import session
from feira.operators.tables import PERIOD_FOLDERS, refresh_table
from feira.plans import purchases, signups
from feira.plans.curated import curate_customers, customer_segments
from feira.sources.marketplace import SCHEMAS, from_files
from oracle import connect, compare
from pyspark.sql import functions as F

Q = contract.report_queries()
ORACLE = oracle_queries.oracle_sql()
SF = str(TESTDATA / "sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan AQE ended with, after running it."""
    df.collect()
    return plan(df).partition("== Initial Plan ==")[0]


def scans(text):
    """Scan lines of the plan, by the first column they read."""
    return [line for line in text.splitlines() if "FileScan" in line]


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield set_
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", sorted(n for n in Q if not n.startswith("stored_")))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(Q[name](spark, SF))
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert node not in text


def test_gmv_reads_what_it_needs(spark, conf):
    conf(maxMetadataStringLength="2000")
    text = plan(Q["gmv_monthly"](spark, SF))
    orders = next(s for s in scans(text) if "o_orderkey" in s)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", orders).group(1)
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01T00:00)" in pushed
    assert "LessThan(o_orderdate,2001-04-01T00:00)" in pushed
    assert "o_custkey" not in orders
    lineitem = next(s for s in scans(text) if "l_orderkey" in s)
    assert lineitem.endswith("ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>")
    # the status half of the flag runs below the seller join
    join = text.index("seller_id")
    assert "o_orderstatus" in text[join:] and "SortAggregate" not in text


def test_unused_address_columns_cost_nothing(spark):
    text = plan(Q["signups_total"](spark, SF))
    assert "n_name" not in text and "r_name" not in text
    assert "SortAggregate" not in text and "LocalTableScan" not in text
    # customers and orders are read, orders twice
    assert len(scans(text)) == 3


@pytest.mark.parametrize("name", ["curated_customers", "last_purchase_per_client"])
def test_ranking_is_pruned_before_the_shuffle(spark, name):
    text = plan(Q[name](spark, SF))
    partial = text.index("row_number(), 1, Partial")
    assert text.index("row_number(), 1, Final") < text.rindex("Exchange", 0, partial) < partial


def test_client_key_needs_no_ranking(spark):
    exchanges = {
        name: plan(Q[name](spark, SF)).count("Exchange hashpartitioning")
        for name in ("curated_customers", "curated_customers_by_client")
    }
    assert exchanges["curated_customers_by_client"] < exchanges["curated_customers"]
    assert "Window" not in plan(Q["curated_customers_by_client"](spark, SF))


def test_funnel_reads_each_curated_table_once(spark):
    text = plan(Q["growth_funnel"](spark, SF))
    assert sum("l_suppkey" in s for s in scans(text)) == 1
    assert sum("c_acctbal" in s for s in scans(text)) == 1
    assert "Expand" not in text


def test_stored_quarters_are_pruned(spark, tmp_path, conf):
    conf(maxMetadataStringLength="2000")
    compras = Q["curated_purchases"](spark, SF)
    stored = refresh_table(compras, str(tmp_path / "t"), PERIOD_FOLDERS, "compra_id")
    report = purchases.gmv_monthly(stored, contract.CFG)
    scan = scans(plan(report))[0]
    filters = re.search(r"PartitionFilters: \[(.*)\], PushedFilters: \[(.*?)\], Read", scan)
    assert "ano" in filters.group(1) and "status_pedido" in filters.group(2)
    folders = stored.select(*PERIOD_FOLDERS).distinct()
    assert (folders.count(), in_quarters_folders(stored)) == (27, 5)


def in_quarters_folders(stored):
    kept = purchases.valid_purchases(stored, contract.CFG)
    return kept.select(F.input_file_name().alias("f")).distinct().count()


def test_hot_quarter_is_written_by_many_tasks(spark, tmp_path, conf):
    conf(adaptive__advisoryPartitionSizeInBytes="64KB")
    compras = Q["curated_purchases"](spark, str(TESTDATA / "sf0.01"))
    spread = str(tmp_path / "spread")
    compras.repartition(8).write.parquet(spread)
    hot = spark.read.parquet(spread).withColumn(
        "ano", F.when(F.col("compra_id") % 3 == 0, 2000).otherwise(F.col("ano"))
    ).withColumn("trimestre", F.when(F.col("ano") == 2000, 1).otherwise(F.col("trimestre")))
    stored = refresh_table(hot, str(tmp_path / "t"), PERIOD_FOLDERS, "compra_id")
    assert stored.count() == 15000
    files = [f for f in stored.inputFiles() if "ano=2000/trimestre=1" in f]
    assert len(files) >= 4


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Tables where one client places a third of the orders and one seller gets a third."""
    root = str(tmp_path_factory.mktemp("skewed"))
    src = TESTDATA / "sf0.01"
    for t in ("customer", "supplier", "nation", "region", "events"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    orders = spark.read.parquet(f"{src}/orders.parquet").repartition(8)
    hot = F.when(F.col("o_orderkey") % 3 == 0, 8).otherwise(F.col("o_custkey"))
    orders.withColumn("o_custkey", hot.cast("bigint")).write.parquet(f"{root}/orders.parquet")
    lines = spark.read.parquet(f"{src}/lineitem.parquet").repartition(8)
    hot = F.when(F.col("l_orderkey") % 3 == 1, 7).otherwise(F.col("l_suppkey"))
    lines.withColumn("l_suppkey", hot.cast("bigint")).write.parquet(f"{root}/lineitem.parquet")
    return root


@pytest.mark.parametrize(
    "name, join_key",
    [
        ("curated_purchases", "comercio_id"),
        ("curated_customers", "o_custkey"),
        ("customer_purchases", "cliente_id"),
        ("customer_purchases_by_client", "cliente_id"),
    ],
)
def test_hot_keys_are_split_past_the_broadcast_size(spark, skewed, conf, name, join_key):
    conf(
        shuffle__partitions="16",
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="8KB",
        adaptive__coalescePartitions__enabled="false",
    )
    text = final_plan(Q[name](spark, skewed))
    splits = [line for line in text.splitlines() if "skew=true" in line]
    assert any(join_key in line for line in splits)


@pytest.mark.parametrize("name", ["curated_purchases", "orders_per_client"])
def test_names_split_a_hot_customer(spark, skewed, conf, name):
    conf(
        shuffle__partitions="16",
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="1KB",
        adaptive__coalescePartitions__enabled="false",
    )
    splits = [line for line in final_plan(Q[name](spark, skewed)).splitlines() if "skew=true" in line]
    assert any("c_custkey" in line for line in splits)


def test_long_email_lists_split_the_deleted_clients(spark, skewed, conf):
    conf(
        shuffle__partitions="16",
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="4KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="2KB",
        adaptive__coalescePartitions__enabled="false",
    )
    market = contract.from_star(spark, skewed)
    gone = market.clientes.withColumn(
        "email", F.when(F.col("id") % 2 == 0, "deleted").otherwise(F.col("email"))
    )
    df = customer_segments(gone.repartition(8), market.segments, contract.CFG)
    splits = [line for line in final_plan(df).splitlines() if "skew=true" in line]
    assert any("lista_email" in line for line in splits)
    assert df.count() == 1500


@pytest.mark.parametrize("name", ["curated_customers", "customer_purchases_by_client",
                                  "seller_sales", "orders_per_client", "growth_funnel"])
def test_parity_under_skew(spark, skewed, conf, name):
    conf(autoBroadcastJoinThreshold="-1")
    con = connect(skewed, "/*.parquet")
    compare(Q[name](spark, skewed), con, ORACLE[name])


def test_shuffles_are_sized_from_the_input_alone(spark, conf):
    conf(adaptive__coalescePartitions__initialPartitionNum="8")
    splits = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def tuned(*size):
        session.tune(spark, *size)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == splits
        return int(spark.conf.get(session.INITIAL_PARTITIONS, "1"))

    assert tuned(100 << 40) == 100 << 10
    assert tuned(3 << 40) == 3072
    assert tuned(1000) == 1
    assert tuned(3 << 40, 1 << 28) == 4 * 3072


def test_read_bytes_runs_no_job(spark):
    files = TESTDATA / "sf0.001"
    df = Q["signups_total"](spark, SF)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("size", "read_bytes")
    try:
        size = session.read_bytes(df)
        assert not tracker.getJobIdsForGroup("size")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    one = {t: (files / f"{t}.parquet").stat().st_size for t in ("customer", "orders", "lineitem")}
    assert one["customer"] + one["orders"] <= size and size % one["customer"] != 0
    assert session.read_bytes(Q["db_app"](spark, SF)) == (files / "events.parquet").stat().st_size


def test_new_files_are_seen(spark, tmp_path):
    for t in ("orders", "lineitem", "customer", "supplier", "nation", "region", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    before = Q["curated_purchases"](spark, str(tmp_path)).count()
    more = spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 10**6)
    more.write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert Q["curated_purchases"](spark, str(tmp_path)).count() == 2 * before


def test_new_files_in_subfolders_are_seen(spark, tmp_path):
    for t in ("orders", "lineitem", "customer", "supplier", "nation", "region", "events"):
        table = spark.read.parquet(f"{SF}/{t}.parquet").withColumn("lote", F.lit(1))
        table.write.partitionBy("lote").parquet(f"{tmp_path}/{t}.parquet")
    before = Q["curated_purchases"](spark, str(tmp_path)).count()
    more = spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 10**6)
    more.write.mode("append").parquet(f"{tmp_path}/orders.parquet/lote=1")
    assert Q["curated_purchases"](spark, str(tmp_path)).count() == 2 * before


def test_names_are_read_not_made_up(spark, tmp_path):
    """Other names, some missing, and orders of customers that are not there."""
    for t in ("orders", "lineitem", "supplier", "nation", "region", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    renamed = spark.read.parquet(f"{SF}/customer.parquet").withColumn(
        "c_name", F.expr("IF(c_custkey % 11 = 0, NULL, 'Pessoa ' || c_custkey % 13)")
    )
    renamed.where("c_custkey % 6 <> 0").write.parquet(f"{tmp_path}/customer.parquet")
    con = connect(str(tmp_path), "/*.parquet")
    for name in (
        "curated_purchases", "orders_per_client", "client_recency", "last_purchase_per_client",
        "spend_per_client", "client_recency_by_name", "snapshot_roundtrip", "stored_purchases",
    ):
        compare(Q[name](spark, str(tmp_path)), con, ORACLE[name])


def test_reports_without_names_do_not_read_customers(spark):
    for name in ("gmv_monthly", "orders_total", "buyers_total"):
        assert not any("c_custkey" in s for s in scans(plan(Q[name](spark, SF))))


def test_client_key_ranks_nothing_and_filters_at_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMAS["clientes"])
    rows.write.parquet(f"{tmp_path}/clientes")
    spark.createDataFrame([], SCHEMAS["enderecos"]).write.parquet(f"{tmp_path}/enderecos")
    spark.createDataFrame([], SCHEMAS["segments"]).write.parquet(f"{tmp_path}/segments")
    m = from_files(spark, str(tmp_path))
    cfg = replace(contract.CFG, dedup_key="client")
    customers = curate_customers(m.clientes, m.enderecos, m.segments, cfg)
    by_client = plan(signups.signups_total(customers, cfg))
    assert "Window" not in by_client
    assert any("GreaterThanOrEqual(time" in s for s in scans(by_client))


def test_storing_again_leaves_the_last_folder(spark):
    """Its result may still be read; the folder goes when the driver ends."""
    first = Q["stored_purchases"](spark, SF).inputFiles()[0]
    again = Q["stored_purchases"](spark, SF)
    assert again.count() == 1500 and again.inputFiles()[0] != first
    assert Path(first.removeprefix("file://").replace("%3D", "=")).exists()
