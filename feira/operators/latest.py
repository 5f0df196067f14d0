"""Keep-the-latest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feira.config import Config
from feira.functions.text import collated

ADDRESS_COLUMNS = ("cep", "bairro", "cidade", "estado")


def latest_addresses(enderecos: DataFrame) -> DataFrame:
    """The address with the highest id of each client.

    An aggregate, not a window: every task sends at most one row per client
    however many addresses one client has, and address columns a report does
    not read drop out of the plan together with the joins behind them.
    """
    return (
        enderecos.where(F.col("cliente_id").isNotNull())
        .groupBy(F.col("cliente_id").alias("endereco_cliente_id"))
        .agg(
            F.max("id").alias("endereco_id"),
            *(F.max_by(c, "id").alias(c) for c in ADDRESS_COLUMNS),
        )
    )


def located_clients(clients: DataFrame, enderecos: DataFrame, cfg: Config) -> DataFrame:
    """Clients with their latest address, the first of each dedup group (``row_num`` is 1).

    Client ids and, after :func:`latest_addresses`, address owners are unique.
    With the ``client`` key each client is a group of its own and nothing is ranked. With the
    ``address`` key all clients without an address share a group per first
    name; Spark prunes each such group to one row per task before it is
    shuffled. Ranking only those and adding the others by a union reads the
    clients and addresses twice and measured slower.
    """
    latest = latest_addresses(enderecos)
    located = clients.join(latest, clients["cliente_id"] == latest["endereco_cliente_id"], "left")
    if cfg.dedup_key == "client":
        return located.withColumn("row_num", F.lit(1))
    group = Window.partitionBy("endereco_cliente_id", collated(F.col("nome"), cfg.text_collation))
    rank = F.row_number().over(group.orderBy("cliente_id"))
    return located.withColumn("row_num", rank).where(F.col("row_num") == 1)


def last_purchase_per_name(compras: DataFrame, cfg: Config) -> DataFrame:
    """Each client's latest purchase under each name used, ``row_num`` = 1."""
    group = Window.partitionBy("cliente_id", collated(F.col("nome"), cfg.text_collation))
    rank = F.row_number().over(group.orderBy(F.desc("dia"), F.desc("compra_id")))
    return compras.withColumn("row_num", rank).where(F.col("row_num") == 1)
