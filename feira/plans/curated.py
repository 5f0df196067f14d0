"""The two curated tables and their join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feira.config import Config
from feira.functions.text import full_name, not_in, strip_hyphens
from feira.operators.checks import join_checked
from feira.operators.flags import flag_active_customers, flag_valid_orders, mark_test_sellers
from feira.operators.latest import ADDRESS_COLUMNS, located_clients
from feira.operators.period import with_period
from feira.operators.skew import own_key
from feira.operators.segments import segment_customers

PERIOD_COLUMNS = ("time", "dia", "mes", "ano", "trimestre")

PURCHASE_COLUMNS = (
    "compra_id",
    "cliente_id",
    "nome",
    "email",
    "valor",
    "frete",
    "comercio_id",
    "nome_fantasia",
    "status",
    "status_pedido",
    "data_compra",
    "quarter",
    *PERIOD_COLUMNS,
)

CUSTOMER_COLUMNS = (
    "cliente_id",
    "nome_completo",
    "email",
    "celular",
    "cpf",
    "cnpj",
    "tipo_pessoa",
    "purchase_type",
    "cep",
    "bairro",
    "cidade",
    "estado",
    "status",
    "status_cliente",
    "data_cadastro",
    "quarter",
    "row_num",
    *PERIOD_COLUMNS,
)


def curate_purchases(pedidos: DataFrame, comercios: DataFrame, cfg: Config) -> DataFrame:
    """Orders with their seller, validity flag and calendar columns."""
    sellers = mark_test_sellers(comercios, cfg).withColumnRenamed("id", "seller_id")
    return _curated(pedidos.join(sellers, pedidos["comercio_id"] == sellers["seller_id"], "left"), cfg)


def curate_purchases_checked(
    pedidos: DataFrame, comercios: DataFrame, cfg: Config, seen: Observation
) -> DataFrame:
    """As :func:`curate_purchases`, where seller ids may repeat: an order is there once, with the seller's least name.

    ``seen`` counts orders, those without their seller and those whose seller repeats; see :func:`join_checked`.
    """
    sellers = mark_test_sellers(comercios, cfg)
    return _curated(join_checked(pedidos, sellers, "comercio_id", "id", seen), cfg)


def _curated(orders: DataFrame, cfg: Config) -> DataFrame:
    flagged = with_period(flag_valid_orders(orders, cfg), "data_compra")
    return flagged.withColumns(
        {"compra_id": F.col("id"), "email": F.lower("email")}
    ).select(*PURCHASE_COLUMNS)


def curate_customers(
    clientes: DataFrame, enderecos: DataFrame, segments: DataFrame, cfg: Config
) -> DataFrame:
    """Clients with their latest address, segment, activity flag and calendar columns.

    Deleted clients (and those without an e-mail) leave after the ranking: when
    one of them is first in its group, the whole group goes.
    """
    clients = clientes.withColumnRenamed("id", "cliente_id")
    located = located_clients(clients, enderecos, cfg)
    kept = located.where(not_in(F.col("email"), cfg.deleted_email))
    flagged = flag_active_customers(segment_customers(kept, segments, cfg), cfg)
    return with_period(flagged, "data_cadastro").withColumns(
        {
            "nome_completo": full_name(F.col("nome"), F.col("sobrenome")),
            "email": F.lower("email"),
            "celular": strip_hyphens(F.col("celular")),
        }
    ).select(*CUSTOMER_COLUMNS)


def customer_segments(clientes: DataFrame, segments: DataFrame, cfg: Config) -> DataFrame:
    """Every client with its segment."""
    return segment_customers(clientes, segments, cfg).select(
        F.col("id").alias("cliente_id"), F.lower("email").alias("email"), "cpf", "purchase_type"
    )


def customer_purchases(customers: DataFrame, purchases: DataFrame) -> DataFrame:
    """Purchases of curated customers, 17 columns.

    One client may own much of the purchases, and customers may come already
    laid out by client; the join lays both sides out anew, so that AQE can
    split such a client with one copy of its customer row.
    """
    cl = customers.select(
        "cliente_id",
        "nome_completo",
        "email",
        "cpf",
        "cnpj",
        *ADDRESS_COLUMNS,
        "purchase_type",
        "data_cadastro",
    )
    cp = purchases.select(
        "cliente_id", "compra_id", "nome_fantasia", "valor", "frete", "status", "data_compra"
    )
    same = own_key(cl["cliente_id"]) == own_key(cp["cliente_id"])
    return cl.join(cp, same, "inner").drop(cp["cliente_id"])
