"""What a build and a refresh cost: tables side by side, marks as bigints, lines of the changed quarters only."""

import threading
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from feira import session
from feira.operators import versions
from feira.plans import warehouse
from feira.plans.curated import curate_purchases
from feira.sources.star import from_star
from tables import TESTDATA

SF = str(TESTDATA / "sf0.001")


def test_both_tables_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    both, real = threading.Barrier(2, timeout=60), warehouse.write_generation

    def write(df, root, table, *rest):
        if table != warehouse.FUNNEL:
            both.wait()  # breaks if one table waits for the other
        return real(df, root, table, *rest)

    monkeypatch.setattr(warehouse, "write_generation", write)
    m = from_star(spark, SF)
    assert warehouse.build_version(contract._earlier(m), str(tmp_path), contract.CFG) == 1
    assert warehouse.refresh_version(m, str(tmp_path), contract.CFG) == 2


def test_an_error_of_either_table_is_raised(spark):
    def broken():
        raise RuntimeError("lost")

    done = []
    for steps in ((broken, lambda: done.append(1)), (lambda: done.append(1), broken)):
        with pytest.raises(RuntimeError, match="lost"):
            session.side_by_side(spark, *steps)
    assert done == [1, 1]


def test_marks_are_sums_of_bigint_hashes(spark):
    """The mark is the exact sum, as decimals gave it, whatever the signs."""
    rows = [(2022, 1 + i % 2, i, f"n{i}", datetime(2022, 1, 5), Decimal(i)) for i in range(1000)] + [(None, None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "ano int, trimestre int, id bigint, nome string, time timestamp_ntz, valor decimal(12,2)")
    hashes = versions.row_marks(sorted(df.columns))
    assert [t for _, t in df.select(*hashes).dtypes] == ["bigint", "bigint"]
    one, two = (h.cast("decimal(20,0)") for h in hashes)
    exact = df.groupBy("ano", "trimestre").agg(F.count("*").alias("n"), F.concat_ws(":", F.sum(one), F.sum(two)).alias("mark"))
    assert versions.marks_by_quarter(df) == {(r.ano, r.trimestre): (r.n, r.mark) for r in exact.collect()}


def test_a_refresh_reads_lines_of_the_changed_quarter(spark, tmp_path, monkeypatch):
    """The lines are filtered by the orders of the quarter before they are grouped; the rows stay those of a full build."""
    root, m = str(tmp_path), from_star(spark, SF)
    warehouse.build_version(contract._earlier(m), root, contract.CFG)
    plans, real = [], warehouse.write_generation

    def write(df, root, table, *rest):
        if table == warehouse.PURCHASES:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, root, table, *rest)

    monkeypatch.setattr(warehouse, "write_generation", write)
    with monkeypatch.context() as patch:
        patch.setitem(session.RUNTIME_FILTERS, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
        session.tune(spark)
        warehouse.refresh_version(m, root, contract.CFG)
    session.tune(spark)
    assert len(plans) == 1 and "might_contain" in plans[0] and "l_orderkey" in plans[0].split("might_contain")[1].split("\n")[0]
    stored = warehouse.open_version(spark, root, contract.CFG)[warehouse.PURCHASES]
    fresh = curate_purchases(m.pedidos, m.comercios, contract.CFG)
    assert stored.count() == fresh.count()
    assert stored.exceptAll(fresh.select(*stored.columns)).isEmpty()
