"""Known results on the given tables, and sums that must agree with each other."""

import pytest

import __spark_entry__ as contract
from tables import TESTDATA

Q = contract.report_queries()
SCALES = ("sf0.001", "sf0.01", "sf0.1")

ROWS = {
    "curated_purchases": (1500, 15000, 150000),
    "curated_customers": (144, 1267, 12494),
    "curated_customers_by_client": (146, 1456, 14554),
    "customer_purchases": (1439, 12658, 124781),
    "app_daily": (324, 361, 361),
    "app_monthly": (13, 13, 13),
    "active_signups_monthly": (12, 12, 12),
    "active_clients_by_segment": (100, 910, 8865),
    "signups_by_cep": (62, 98, 98),
    "signups_by_bairro": (6, 6, 6),
    "signups_by_cidade": (24, 25, 25),
    "signups_by_estado": (5, 5, 5),
    "gmv_monthly": (15, 15, 15),
    "orders_monthly": (15, 15, 15),
    "orders_per_client": (79, 966, 9648),
    "spend_per_client": (79, 966, 9648),
    "client_recency": (79, 966, 9648),
    "client_recency_by_name": (79, 966, 9648),
    "last_purchase_per_client": (84, 1058, 10510),
    "seller_sales": (10, 90, 875),
    "seller_month_literal": (10, 90, 875),
    "seller_month": (68, 698, 6811),
}

VALUES = {
    "app_totals": ((188, 199), (1982, 2017), (19941, 20302)),
    "signups_total": ((110,), (994,), (9723,)),
    "active_signups_total": ((100,), (910,), (8865,)),
    "orders_total": ((111,), (1583,), (15403,)),
    "buyers_total": ((79,), (966,), (9648,)),
    "growth_funnel": (
        (188, 199, 110, 100, 65, 21),
        (1982, 2017, 994, 910, 846, 298),
        (19941, 20302, 9723, 8865, 8452, 2828),
    ),
}

SEGMENTS = ((36, 1, 63), (308, 1, 601), (2924, 1, 5940))
NO_SELLER = ("1868344.18", "9076536.21", "91062487.81")


@pytest.mark.parametrize("name", sorted(ROWS))
@pytest.mark.parametrize("at", range(3), ids=SCALES)
def test_row_counts(spark, at, name):
    assert Q[name](spark, f"{TESTDATA}/{SCALES[at]}").count() == ROWS[name][at]


@pytest.mark.parametrize("name", sorted(VALUES))
@pytest.mark.parametrize("at", range(3), ids=SCALES)
def test_single_rows(spark, at, name):
    assert [tuple(r) for r in Q[name](spark, f"{TESTDATA}/{SCALES[at]}").collect()] == [
        VALUES[name][at]
    ]


@pytest.mark.parametrize("at", range(3), ids=SCALES)
def test_agreeing_sums(spark, at):
    def run(name):
        return Q[name](spark, f"{TESTDATA}/{SCALES[at]}").collect()

    def total(name, column):
        return sum(r[column] for r in run(name))

    active = run("active_signups_total")[0][0]
    segments = {r.purchase_type: r.tipos_clientes_2022 for r in run("signups_by_segment")}
    assert tuple(segments[k] for k in ("ATACADO", "MINIMARKET", "VAREJO")) == SEGMENTS[at]
    assert sum(segments.values()) == active
    assert total("active_signups_monthly", "cadastro_ativos_mes") == active

    orders = run("orders_total")[0][0]
    assert total("orders_monthly", "pedidos") == orders
    assert total("orders_per_client", "qtd_compra") == orders
    assert total("seller_month", "venda_seller_mes") == orders
    assert total("seller_month_literal", "venda_seller_mes") == orders

    gmv = total("gmv_monthly", "gmv")
    sellers = {r.seller: r for r in run("seller_sales")}
    assert total("spend_per_client", "valor_total_compras") == gmv
    assert sum(r.valor_vendas for r in sellers.values()) == gmv
    assert (sellers[None].qtd_vendas, str(sellers[None].valor_vendas)) == (0, NO_SELLER[at])
