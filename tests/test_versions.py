"""Versions: one switch for all tables, partial refreshes, and what happens when a refresh fails."""

import os
import random
import shutil
import threading
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError

import __spark_entry__ as contract
from feira.config import Config
from feira.operators import versions
from feira.plans import warehouse
from feira.plans.curated import curate_customers, curate_purchases
from feira.sources.marketplace import Marketplace
from tables import TESTDATA, app, cliente, clientes, comercios, enderecos, pedidos, segments

CFG = Config(as_of=date(2023, 5, 1))
BY_CLIENT = Config(as_of=date(2023, 5, 1), dedup_key="client")


def order(i, cliente_id=1, valor="1.00", seller=1, status=None, time=datetime(2022, 1, 5)):
    return (i, cliente_id, "Ana", valor, seller, status, time)


BASE = {
    "pedidos": [
        order(1),
        order(2, time=datetime(2022, 4, 5)),
        order(3, 2, time=datetime(2022, 4, 6)),
        order(4, time=datetime(2022, 11, 5)),
        order(5, time=None),
    ],
    "comercios": [(1, "Um"), (2, "Dois")],
    "clientes": [
        cliente(1),
        cliente(2, nome="Bia", time=None),
        cliente(3, nome="Cid", email="cid@mail.com", time=datetime(2022, 9, 1)),
    ],
    "enderecos": [(1, 1, "x"), (2, 3, "y")],
    "app": [(date(2022, 1, 1), 3, 1)],
}


def market(spark, **changed):
    rows = BASE | changed
    tables = {
        "pedidos": pedidos(spark, *rows["pedidos"]) if rows["pedidos"] else pedidos(spark, order(1)).where("false"),
        "comercios": comercios(spark, *rows["comercios"]),
        "clientes": clientes(spark, *rows["clientes"]),
        "enderecos": enderecos(spark, *rows["enderecos"]),
        "analytics_app": app(spark, *rows["app"]),
        "segments": segments(spark, ("cid@mail.com", "MINIMARKET")),
    }
    return Marketplace(tables.__getitem__)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A folder with one version of the base tables; tests work on copies of it."""
    root = str(tmp_path_factory.mktemp("built"))
    assert warehouse.build_version(market(spark), root, CFG) == 1
    return root


@pytest.fixture
def root(built, tmp_path):
    return shutil.copytree(built, str(tmp_path / "root"))


def bag(df):
    return Counter(map(str, df.collect()))


def assert_as_built(spark, root, m, cfg=CFG):
    tables = warehouse.open_version(spark, root, cfg)
    assert bag(tables[warehouse.PURCHASES]) == bag(curate_purchases(m.pedidos, m.comercios, cfg))
    assert bag(tables[warehouse.CUSTOMERS]) == bag(curate_customers(m.clientes, m.enderecos, m.segments, cfg))


def written(spark, root, table, version):
    """The quarters of a table whose folders this version wrote."""
    parts = warehouse.version_parts(spark, root).where(f"tabela = '{table}' AND versao = {version}").collect()
    return {(p.ano, p.trimestre) for p in parts}


def test_an_added_order_rewrites_one_folder(spark, root):
    more = market(spark, pedidos=[*BASE["pedidos"], order(6, 2, "7.00", time=datetime(2022, 12, 30))])
    assert warehouse.refresh_version(more, root, CFG) == 2
    assert written(spark, root, warehouse.PURCHASES, 2) == {(2022, 4)}
    assert written(spark, root, warehouse.CUSTOMERS, 2) == set()
    assert_as_built(spark, root, more)
    assert [tuple(r) for r in warehouse.open_version(spark, root, CFG)[warehouse.FUNNEL].collect()] == [(3, 1, 2, 2, 2, 2)]


CHANGES = {
    "valor": ({"pedidos": [order(1, valor="9.00"), *BASE["pedidos"][1:]]}, {(2022, 1)}, set()),
    "order gone": ({"pedidos": BASE["pedidos"][:3] + BASE["pedidos"][4:]}, set(), set()),
    "order moves": ({"pedidos": [order(1, time=datetime(2022, 4, 1)), *BASE["pedidos"][1:]]}, {(2022, 2)}, set()),
    "order without a time": ({"pedidos": [*BASE["pedidos"], order(6, time=None)]}, {(None, None)}, set()),
    "order twice": ({"pedidos": [*BASE["pedidos"], order(4, time=datetime(2022, 11, 5))]}, {(2022, 4)}, set()),
    "no orders": ({"pedidos": []}, set(), set()),
    "seller": ({"comercios": [(1, "Um - Test"), (2, "Dois")]}, {(2022, 1), (2022, 2), (2022, 4), (None, None)}, set()),
    "phone": ({"clientes": [cliente(1, celular="0"), *BASE["clientes"][1:]]}, set(), {(2022, 2)}),
    "address": ({"enderecos": [*BASE["enderecos"], (9, 3, "z")]}, set(), {(2022, 3)}),
    "client gone": ({"clientes": BASE["clientes"][:2]}, set(), set()),
    "client moves": (
        {"clientes": [cliente(1, time=datetime(2022, 9, 9)), *BASE["clientes"][1:]]}, set(), {(2022, 3)},
    ),
    "client gets a time": (
        {"clientes": [BASE["clientes"][0], cliente(2, nome="Bia"), BASE["clientes"][2]]}, set(), {(2022, 2)},
    ),
}


@pytest.mark.parametrize("name", sorted(CHANGES))
def test_refreshes_equal_full_builds(spark, root, name):
    changed, purchase_folders, customer_folders = CHANGES[name]
    after = market(spark, **changed)
    warehouse.refresh_version(after, root, CFG)
    assert_as_built(spark, root, after)
    assert written(spark, root, warehouse.PURCHASES, 2) == purchase_folders
    assert written(spark, root, warehouse.CUSTOMERS, 2) == customer_folders
    # the version before is still whole
    before = warehouse.open_version(spark, root, CFG, 1)[warehouse.PURCHASES]
    assert bag(before) == bag(curate_purchases(market(spark).pedidos, market(spark).comercios, CFG))


def test_random_refreshes_equal_full_builds(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path)
    times = [None, *(datetime(2021 + k // 4, 1 + k % 4 * 3, 2) for k in range(8))]
    orders = {i: order(i, rng.randrange(1, 4), time=rng.choice(times)) for i in range(40)}
    people = {i: cliente(i, nome=f"N{i % 3}", time=rng.choice(times)) for i in range(1, 20)}
    for step in range(3):
        m = market(spark, pedidos=list(orders.values()), clientes=list(people.values()))
        assert warehouse.refresh_version(m, root, BY_CLIENT) == step + 1
        assert_as_built(spark, root, m, BY_CLIENT)
        for _ in range(3):
            i = rng.randrange(50)
            orders[i] = order(i, rng.randrange(1, 4), f"{rng.randrange(9)}.50", time=rng.choice(times))
            people[rng.randrange(1, 25)] = cliente(k := rng.randrange(1, 25), nome="N1", celular=str(i), time=rng.choice(times))
            people = {p[0]: p for p in people.values()} | {k: cliente(k, celular="7", time=rng.choice(times))}
        orders.pop(rng.choice(sorted(orders)))


def test_nothing_new_publishes_nothing(spark, root):
    assert warehouse.refresh_version(market(spark), root, CFG) == 1
    assert versions.versions(spark, root) == [1]
    assert warehouse.refresh_version(market(spark, app=[(date(2022, 1, 1), 8, 1)]), root, CFG) == 2  # the funnel only
    assert written(spark, root, warehouse.PURCHASES, 2) == written(spark, root, warehouse.CUSTOMERS, 2) == set()


@pytest.mark.parametrize("fails", ["growth_funnel", "publish_parts", "curate_customers"])
def test_a_failed_refresh_changes_nothing(spark, root, monkeypatch, fails):
    before = {name: bag(df) for name, df in warehouse.open_version(spark, root, CFG).items()}
    more = market(spark, pedidos=[*BASE["pedidos"], order(6)])

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(warehouse, "table_schemas", lambda spark, cfg, held=warehouse.table_schemas(spark, CFG): held)
        patch.setattr(warehouse, fails, broken)
        for refresh in (warehouse.build_version, warehouse.refresh_version):
            with pytest.raises(RuntimeError):
                refresh(more, root, CFG)
    assert versions.versions(spark, root) == [1]
    assert {name: bag(df) for name, df in warehouse.open_version(spark, root, CFG).items()} == before
    assert warehouse.refresh_version(more, root, CFG) == 2
    assert_as_built(spark, root, more)


def test_two_refreshes_cannot_publish_one_version(spark, root):
    first = versions.parts_of(spark, root, 1)
    with pytest.raises(Py4JJavaError):
        versions.publish_parts(spark, root, 1, [])
    assert versions.parts_of(spark, root, 1) == first
    assert warehouse.open_version(spark, root, CFG)[warehouse.PURCHASES].count() == 5


def test_readers_see_only_whole_versions(spark, root):
    """While versions with 5 and 6 orders, 3 and 4 clients are published in turn, a reader never sees a mixture."""
    small = market(spark)
    large = market(spark, pedidos=[*BASE["pedidos"], order(6)], clientes=[*BASE["clientes"], cliente(4, nome="Dea")])
    seen, stop, failed = set(), threading.Event(), []

    def read():
        try:
            while not stop.is_set():
                tables = warehouse.open_version(spark, root, CFG)
                seen.add((tables[warehouse.PURCHASES].count(), tables[warehouse.CUSTOMERS].count(), tables[warehouse.FUNNEL].count()))
        except Exception as error:  # reported below
            failed.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for m in (large, small, large):
            warehouse.refresh_version(m, root, CFG)
    finally:
        stop.set()
        reader.join()
    assert not failed
    assert seen and seen <= {(5, 3, 1), (6, 4, 1)}
    assert versions.versions(spark, root) == [1, 2, 3, 4]


def test_views_change_all_at_once(spark, root):
    warehouse.create_version_views(spark, root, CFG)
    try:
        question = """SELECT (SELECT count(*) FROM analytics_compras) AS pedidos,
                             (SELECT count(*) FROM analytics_clientes) AS clientes,
                             (SELECT qtd_clientes_compraram FROM growth_funil) AS compradores"""
        assert tuple(spark.sql(question).first()) == (5, 3, 2)
        assert spark.table(warehouse.PURCHASES).schema.simpleString() == warehouse.table_schemas(spark, CFG)[warehouse.PURCHASES].simpleString()
        more = market(spark, pedidos=[*BASE["pedidos"], order(6, 3)], clientes=[*BASE["clientes"], cliente(4, nome="Dea")])
        warehouse.refresh_version(more, root, CFG)
        assert tuple(spark.sql(question).first()) == (5, 3, 2)
        warehouse.publish_seen(spark)
        assert tuple(spark.sql(question).first()) == (6, 4, 3)
        warehouse.refresh_version(market(spark, pedidos=[]), root, CFG)
        warehouse.publish_seen(spark)
        assert tuple(spark.sql(question).first()) == (0, 3, 0)
    finally:
        for name in (warehouse.PURCHASES, warehouse.CUSTOMERS, warehouse.FUNNEL):
            spark.sql(f"DROP VIEW IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {warehouse.MANIFEST}")


def test_vacuum_keeps_what_the_kept_versions_name(spark, root, tmp_path):
    for k in range(3):
        m = market(spark, pedidos=[*BASE["pedidos"], order(10 + k, time=datetime(2022, 12, 1 + k))])
        warehouse.refresh_version(m, root, CFG)
    gone = versions.vacuum(spark, root, keep=2)
    assert versions.versions(spark, root) == [3, 4]
    assert sum("manifest" in g for g in gone) == 2
    assert any(f"{warehouse.PURCHASES}/geracao=g00000002" in g for g in gone)
    assert not any(f"{warehouse.PURCHASES}/geracao=g00000001" in g for g in gone)  # its other quarters are in use
    assert_as_built(spark, root, m)
    assert warehouse.open_version(spark, root, CFG, 3)[warehouse.PURCHASES].count() == 6
    assert versions.vacuum(spark, str(tmp_path / "none")) == []


def test_only_changed_quarters_are_read_and_written_again(spark, tmp_path, monkeypatch):
    """On the given tables: one quarter of 28 is written, from a scan with that period."""
    root, m = str(tmp_path), contract.from_star(spark, str(TESTDATA / "sf0.001"))
    warehouse.build_version(contract._earlier(m), root, contract.CFG)
    plans, real = [], warehouse.write_generation

    def write(df, root, table, *rest):
        if table == warehouse.PURCHASES:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, root, table, *rest)

    monkeypatch.setattr(warehouse, "write_generation", write)
    warehouse.refresh_version(m, root, contract.CFG)
    assert written(spark, root, warehouse.PURCHASES, 2) == {(2000, 4)}
    assert len(plans) == 1 and "GreaterThanOrEqual(o_orderdate,2000-10-01" in plans[0]
    folder = f"{root}/{warehouse.PURCHASES}"
    new = [d for d in os.listdir(folder) if d.startswith("geracao=g00000002")]
    assert len(new) == 1 and [d for d in os.listdir(f"{folder}/{new[0]}") if "=" in d] == ["ano=2000"]


STORING = [
    "stored_purchases",
    "stored_customers",
    "stored_gmv_monthly",
    "stored_growth_funnel",
    "published_gmv_monthly",
    "snapshot_rejects",
]


@pytest.mark.parametrize("name", STORING)
def test_stored_results_outlive_later_calls(spark, name):
    """Two calls on two folders, and one more on the first: each result is still there."""
    query = contract.report_queries()[name]
    small, large = str(TESTDATA / "sf0.001"), str(TESTDATA / "sf0.01")
    first, second, third = query(spark, small), query(spark, large), query(spark, small)
    assert bag(first) == bag(third)
    assert second.count() >= first.count() > 0


def test_money_survives_versions(spark, root):
    tables = warehouse.open_version(spark, root, CFG)
    assert {r.valor for r in tables[warehouse.PURCHASES].collect()} == {Decimal("1.00")}
