from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feira.config import Config
from feira.operators.aggregates import count_by
from feira.plans import funnel, purchases, signups, traffic
from feira.plans.curated import curate_customers, curate_purchases
from tables import app, cliente, clientes, comercios, enderecos, pedidos, rows, segments

CFG = Config(as_of=date(2023, 5, 1))


@pytest.fixture(scope="module")
def compras(spark):
    orders = pedidos(
        spark,
        (1, 1, "Bia", "10.10", 1, None, datetime(2022, 1, 5)),
        (2, 1, "Ana", "20.20", 1, None, datetime(2022, 12, 5)),
        (3, 2, "Caio", "30.00", None, None, datetime(2023, 1, 5)),
        (4, 2, "Caio", "30.00", 2, None, datetime(2023, 1, 5)),
        (5, 3, "Davi", "99.00", 3, None, datetime(2022, 3, 1)),
        (6, 4, "Eva", "99.00", 1, "Cancelado", datetime(2022, 3, 1)),
        (7, 5, "Gil", "99.00", 1, None, datetime(2023, 4, 1)),
        (8, None, "Hugo", "1.00", 1, None, datetime(2022, 11, 1)),
    )
    shops = comercios(spark, (1, "Um"), (2, "Dois"), (3, "Tres - Test"))
    return curate_purchases(orders, shops, CFG).cache()


@pytest.fixture(scope="module")
def customers(spark):
    cl = [
        cliente(1, time=datetime(2022, 2, 1)),
        cliente(2, time=datetime(2022, 2, 3), status="Inativo"),
        cliente(3, time=datetime(2022, 11, 3), cpf=None),
        cliente(4, time=datetime(2021, 11, 3)),
        cliente(5, time=None),
        cliente(6, time=datetime(2022, 1, 1), email="deleted"),
        cliente(7, nome="Zoe", time=datetime(2022, 1, 1)),
    ]
    homes = [(i, i, "A" if i < 3 else "B") for i in range(1, 7)]
    return curate_customers(
        clientes(spark, *cl), enderecos(spark, *homes), segments(spark), CFG
    ).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return (
        app(spark),
        curate_customers(clientes(spark), enderecos(spark), segments(spark), CFG),
        curate_purchases(pedidos(spark), comercios(spark), CFG),
    )


def test_monthly_series(compras):
    gmv = purchases.gmv_monthly(compras, CFG)
    assert sorted(rows(gmv)) == [
        ("01-2022", Decimal("10.10")),
        ("01-2023", Decimal("60.00")),
        ("11-2022", Decimal("1.00")),
        ("12-2022", Decimal("20.20")),
    ]
    calendar = purchases.gmv_monthly(compras, CFG, keep_month=True).orderBy("mes")
    assert [r.mes_ano for r in calendar.collect()] == ["01-2022", "11-2022", "12-2022", "01-2023"]
    assert sorted(rows(purchases.orders_monthly(compras, CFG, "pedidos_mes"))) == [
        ("01-2022", 1), ("01-2023", 2), ("11-2022", 1), ("12-2022", 1),
    ]


def test_totals(compras):
    assert rows(purchases.orders_total(compras, CFG)) == [(5,)]
    assert rows(purchases.buyers_total(compras, CFG)) == [(2,)]


def test_per_client(compras):
    assert rows(purchases.orders_per_client(compras, CFG)) == [
        (1, "Ana", "ana@mail.com", 2),
        (2, "Caio", "caio@mail.com", 2),
        (None, "Hugo", "hugo@mail.com", 1),
    ]
    assert [r.valor_total_compras for r in purchases.spend_per_client(compras, CFG).collect()] == [
        Decimal("60.00"), Decimal("30.30"), Decimal("1.00"),
    ]


def test_recency(compras):
    got = rows(purchases.client_recency(compras, CFG))
    assert got[:2] == [
        (2, "Caio", "caio@mail.com", date(2023, 1, 5), 116),
        (1, "Ana", "ana@mail.com", date(2022, 12, 5), 147),
    ]
    last = purchases.last_purchase_per_client(compras, CFG)
    assert sorted(r.compra_id for r in last.collect()) == [1, 2, 4, 8]
    by_name = {r.cliente_id: r for r in purchases.client_recency_by_name(compras, CFG).collect()}
    assert by_name[1].nome == "Ana" and by_name[1].diff_compra_dias == 147


def test_sellers(compras):
    assert rows(purchases.seller_sales(compras, CFG)) == [
        ("Um", 3, Decimal("31.30")),
        (None, 0, Decimal("30.00")),
        ("Dois", 1, Decimal("30.00")),
    ]
    assert rows(purchases.seller_month(compras, CFG)) == [
        ("01-2022", "Um", 1),
        ("01-2023", None, 1),
        ("01-2023", "Dois", 1),
        ("11-2022", "Um", 1),
        ("12-2022", "Um", 1),
    ]
    assert rows(purchases.seller_month_literal(compras, CFG)) == [
        ("01-2022", "Um", 3), ("01-2023", None, 1), ("01-2023", "Dois", 1),
    ]


def test_signups(customers):
    assert rows(signups.signups_total(customers, CFG)) == [(4,)]
    assert rows(signups.active_signups_total(customers, CFG)) == [(3,)]
    assert rows(signups.active_signups_monthly(customers, CFG)) == [
        ("01-2022", 1), ("02-2022", 1), ("11-2022", 1),
    ]
    assert rows(signups.active_clients_by_segment(customers, CFG)) == [
        (3, "Ana Lima", "ATACADO"), (1, "Ana Lima", "VAREJO"), (7, "Zoe Lima", "VAREJO"),
    ]
    assert sorted(rows(signups.signups_by_segment(customers, CFG))) == [("ATACADO", 1), ("VAREJO", 2)]


def test_places(customers):
    assert rows(signups.signups_by_cep(customers, CFG)) == [("A", 1), ("B", 1), (None, 0)]
    assert rows(signups.signups_by_bairro(customers, CFG)) == [("Centro", 2), (None, 0)]
    assert rows(signups.signups_by_cidade(customers, CFG)) == [("Santos", 2)]
    assert rows(signups.signups_by_estado(customers, CFG)) == [("SP", 2)]
    assert rows(signups.signups_by_estado(customers, replace(CFG, invalid_state="SP"))) == []


def test_count_by_collation(spark):
    df = spark.createDataFrame([("São",), ("SAO",), ("Rio",), (None,)], "cidade string")
    binary = {r[1] for r in count_by(df, "cidade", "n").collect()}
    assert binary == {1, 0}
    for turned in (df, df.orderBy(F.desc("cidade")), df.orderBy("cidade")):
        folded = count_by(turned.coalesce(1), "cidade", "n", "UNICODE_CI_AI")
        assert folded.dtypes == [("cidade", "string"), ("n", "bigint")]
        assert {tuple(r) for r in folded.collect()} == {("SAO", 2), ("Rio", 1), (None, 0)}


def test_reports_follow_the_collation(spark):
    cfg = replace(CFG, text_collation="UNICODE_CI_AI")
    shops = comercios(spark, (1, "Pão"), (2, "PAO"))
    at = datetime(2022, 5, 1)
    orders = pedidos(
        spark, (1, 1, "José", "1", 1, "Entregue", at), (2, 1, "JOSE", "2", 2, "CANCELADO", at),
        (3, 1, "jose", "3", 2, "Entregue", at),
    )
    compras = curate_purchases(orders, shops, cfg)
    assert rows(purchases.seller_sales(compras, cfg)) == [("PAO", 2, Decimal("4.00"))]
    assert rows(purchases.seller_month(compras, cfg)) == [("05-2022", "PAO", 2)]
    assert rows(purchases.seller_month_literal(compras, cfg)) == [("05-2022", "PAO", 2)]
    assert purchases.seller_sales(compras, cfg).dtypes[0] == ("seller", "string")
    assert [r.compra_id for r in purchases.last_purchase_per_client(compras, cfg).collect()] == [3]
    binary = curate_purchases(orders, shops, CFG)
    assert purchases.seller_sales(binary, CFG).count() == 2
    assert purchases.last_purchase_per_client(binary, CFG).count() == 3


def test_traffic(spark):
    days = app(spark, (date(2022, 1, 1), 3, 1), (date(2022, 1, 9), 4, None), (None, 5, 2),
               (date(2023, 1, 9), 1, 1))
    assert rows(traffic.app_totals(days)) == [(13, 4)]
    assert sorted(rows(traffic.app_monthly(days)), key=str) == [
        ("01-2022", 7, 1), ("01-2023", 1, 1), (None, 5, 2),
    ]


def test_funnel(spark, customers, compras):
    days = app(spark, (date(2022, 1, 1), 3, 1))
    # the buyers' windows leave out 2023
    assert rows(funnel.growth_funnel(days, customers, compras, CFG)) == [(3, 1, 4, 3, 1, 1)]


def test_empty_tables(empty):
    days, customers, compras = empty
    assert rows(traffic.app_totals(days)) == [(None, None)]
    assert rows(signups.signups_total(customers, CFG)) == [(0,)]
    assert rows(purchases.orders_total(compras, CFG)) == [(0,)]
    assert rows(purchases.gmv_monthly(compras, CFG)) == []
    assert rows(funnel.growth_funnel(days, customers, compras, CFG)) == [(None, None, 0, 0, 0, 0)]
