from dataclasses import replace
from datetime import datetime

import pytest

from feira.config import Config
from feira.plans.curated import (
    curate_customers,
    curate_purchases,
    customer_purchases,
    customer_segments,
)
from tables import T0, cliente, clientes, comercios, enderecos, pedidos, rows, segments

CFG = Config()
BY_CLIENT = replace(CFG, dedup_key="client")


def _customers(spark, cl, en=(), seg=(), cfg=CFG):
    return curate_customers(
        clientes(spark, *cl), enderecos(spark, *en), segments(spark, *seg), cfg
    )


def test_valid_order_flag(spark):
    shops = comercios(spark, (1, "Loja"), (2, "Loja - Test"), (3, "loja - TESTE"), (4, None))
    orders = pedidos(
        spark,
        (1, 9, "A", "10", 1, "Entregue", T0),
        (2, 9, "A", "10", 1, "Cancelado", T0),
        (3, 9, "A", "10", 1, "Pagamento recusado", T0),
        (4, 9, "A", "10", 1, None, T0),
        (5, 9, "A", "10", None, "Entregue", T0),
        (6, 9, "A", "10", 77, "Entregue", T0),
        (7, 9, "A", "10", 2, "Entregue", T0),
        (8, 9, "A", "10", 3, "Entregue", T0),
        (9, 9, "A", "10", 4, "Entregue", T0),
        (10, 9, "A", "10", 2, None, T0),
        (11, 9, "A", "10", None, "Cancelado", T0),
    )
    got = curate_purchases(orders, shops, CFG).orderBy("compra_id")
    assert [r.status_pedido for r in got.collect()] == [1, 0, 0, 1, 1, 1, 0, 0, 1, 0, 0]
    assert got.where("compra_id = 6").first().nome_fantasia is None
    assert got.first().email == "a@mail.com"


def test_segments(spark):
    lists = [("Big@Mail.com", "ATACADO"), ("mini@mail.com", "MINIMARKET"),
             ("both@mail.com", "MINIMARKET"), ("BOTH@mail.com", "ATACADO"),
             ("both@mail.com", "MINIMARKET")]
    cl = [
        cliente(1, email="big@mail.com"),
        cliente(2, email="MINI@mail.com"),
        cliente(3, email="mini@mail.com", cpf=None),
        cliente(4, email="Both@Mail.com"),
        cliente(5, email="other@mail.com"),
        cliente(6, email="other@mail.com", cpf=None),
    ]
    want = ["ATACADO", "MINIMARKET", "ATACADO", "ATACADO", "VAREJO", "ATACADO"]
    got = _customers(spark, cl, [(i, i, "1") for i in range(1, 7)], lists).orderBy("cliente_id")
    assert [r.purchase_type for r in got.collect()] == want
    alone = customer_segments(clientes(spark, *cl), segments(spark, *lists), CFG)
    assert [r.purchase_type for r in alone.orderBy("cliente_id").collect()] == want


def test_active_flag_name_and_phone(spark):
    cl = [
        cliente(1, email="Ana@Mail.com", celular="11-98-7"),
        cliente(2, status="Inativo"),
        cliente(3, status=None),
        cliente(4, sobrenome=None),
    ]
    got = _customers(spark, cl, [(i, i, "1") for i in range(1, 5)]).orderBy("cliente_id").collect()
    assert [r.status_cliente for r in got] == [1, 0, 0, 1]
    assert [r.nome_completo for r in got] == ["Ana Lima", "Ana Lima", "Ana Lima", None]
    assert (got[0].email, got[0].celular) == ("ana@mail.com", "11987")


def test_latest_address(spark):
    cl = [cliente(1), cliente(2), cliente(3, nome="Bia")]
    en = [(5, 1, "old"), (9, 1, None), (7, 2, "only"), (8, 99, "stray")]
    got = _customers(spark, cl, en).select("cliente_id", "cep", "cidade").orderBy("cliente_id")
    # the latest address wins even where its postcode is missing
    assert rows(got) == [(1, None, "Santos"), (2, "only", "Santos"), (3, None, None)]


@pytest.mark.parametrize("cfg, ids", [(CFG, [1, 3, 5]), (BY_CLIENT, [1, 3, 4, 5, 6])])
def test_clients_without_address_share_a_group_per_name(spark, cfg, ids):
    cl = [cliente(1), cliente(4), cliente(3), cliente(5, nome="Bia"), cliente(6, nome="Bia")]
    got = _customers(spark, cl, [(1, 1, "x")], cfg=cfg).orderBy("cliente_id")
    assert [r.cliente_id for r in got.collect()] == ids
    assert {r.row_num for r in got.collect()} == {1}


@pytest.mark.parametrize("gone", ["deleted", "DELETED", None])
def test_group_goes_with_its_deleted_survivor(spark, gone):
    cl = [cliente(1, email=gone), cliente(2), cliente(3, nome="Bia")]
    assert [r.cliente_id for r in _customers(spark, cl).collect()] == [3]
    by_client = _customers(spark, cl, cfg=BY_CLIENT).orderBy("cliente_id")
    assert [r.cliente_id for r in by_client.collect()] == [2, 3]


def test_unknown_dedup_key():
    with pytest.raises(ValueError):
        Config(dedup_key="name")


def test_detail_join(spark):
    shops = comercios(spark, (1, "Loja"))
    orders = pedidos(
        spark,
        *((i, 1, "Ana", "10", 1, "Cancelado", T0) for i in range(20)),
        (90, 2, "Bia", "5", None, None, datetime(2022, 1, 2)),
        (91, 77, "X", "5", 1, None, T0),
        (92, None, "X", "5", 1, None, T0),
    )
    customers = _customers(spark, [cliente(1), cliente(2, nome="Bia")], [(3, 1, "x")])
    detail = customer_purchases(customers, curate_purchases(orders, shops, CFG))
    assert len(detail.columns) == 17
    got = sorted(rows(detail.select("cliente_id", "compra_id", "cep", "nome_fantasia", "data_compra")))
    assert got == [(1, i, "x", "Loja", "2022-05-01") for i in range(20)] + [
        (2, 90, None, None, "2022-01-02")
    ]


def test_collation_folds_case_and_accents(spark):
    cfg = replace(CFG, text_collation="UNICODE_CI_AI")
    cl = [cliente(1, nome="José"), cliente(2, nome="JOSE", status="ativo")]
    assert _customers(spark, cl).count() == 2
    assert [r.cliente_id for r in _customers(spark, cl, cfg=cfg).collect()] == [1]
    en = [(1, 1, "x"), (2, 2, "x")]
    flags = {cfg: _customers(spark, cl, en, cfg=cfg).orderBy("cliente_id").collect() for cfg in (CFG, cfg)}
    assert [r.status_cliente for r in flags[CFG]] == [1, 0]
    assert [r.status_cliente for r in flags[cfg]] == [1, 1]
