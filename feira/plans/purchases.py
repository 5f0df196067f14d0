"""Purchase reports over the curated purchases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.config import Config
from feira.functions.dates import days_since, month_label
from feira.operators.aggregates import by_text, monthly, per_client, text_label, total
from feira.operators.bitmaps import count_distinct_merged
from feira.operators.breakdowns import SET, by_each, set_number
from feira.operators.latest import last_purchase_per_name
from feira.operators.period import in_quarters
from feira.operators.windows import REPORT, in_windows


def valid_purchases(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Valid orders of the purchase window."""
    return in_quarters(purchases, cfg.windows.purchases).where(F.col("status_pedido") == 1)


def gmv_monthly(purchases: DataFrame, cfg: Config, keep_month: bool = False) -> DataFrame:
    """In calendar order when the month is kept."""
    valid = valid_purchases(purchases, cfg)
    sums = monthly(valid, "mes", total("valor").alias("gmv"), keep_month=keep_month)
    return sums.orderBy("mes") if keep_month else sums


def orders_monthly(purchases: DataFrame, cfg: Config, name: str = "pedidos") -> DataFrame:
    return monthly(valid_purchases(purchases, cfg), "mes", F.count("compra_id").alias(name))


def orders_total(purchases: DataFrame, cfg: Config) -> DataFrame:
    return valid_purchases(purchases, cfg).agg(F.count("compra_id").alias("pedidos_2022"))


def buyers_total(purchases: DataFrame, cfg: Config) -> DataFrame:
    buyers = F.count_distinct("cliente_id")
    return valid_purchases(purchases, cfg).agg(buyers.alias("qtd_clientes_compraram"))


def orders_per_client(purchases: DataFrame, cfg: Config) -> DataFrame:
    valid = valid_purchases(purchases, cfg)
    counts = per_client(valid, F.count("compra_id").alias("qtd_compra"))
    return counts.orderBy(F.desc("qtd_compra"), "cliente_id")


def spend_per_client(purchases: DataFrame, cfg: Config) -> DataFrame:
    valid = valid_purchases(purchases, cfg)
    totals = per_client(valid, total("valor").alias("valor_total_compras"))
    return totals.orderBy(F.desc("valor_total_compras"), "cliente_id")


def client_recency(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Days since each client's latest valid purchase, most recent first."""
    valid = valid_purchases(purchases, cfg)
    latest = per_client(valid, F.max("dia").alias("data_ultima_compra"))
    return _with_recency(latest, cfg)


def client_recency_by_name(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Recency from the latest purchase under one name of each client.

    A client who bought under several names has several latest purchases; the
    alphabetically first name decides.
    """
    row = F.struct("nome", "email", "dia")
    latest = (
        last_purchase_per_name(valid_purchases(purchases, cfg), cfg)
        .groupBy("cliente_id")
        .agg(F.min(row).alias("r"))
        .select("cliente_id", "r.nome", "r.email", F.col("r.dia").alias("data_ultima_compra"))
    )
    return _with_recency(latest, cfg)


def _with_recency(latest: DataFrame, cfg: Config) -> DataFrame:
    days = days_since(F.col("data_ultima_compra"), cfg.as_of)
    return latest.select(
        "cliente_id", "nome", "email", "data_ultima_compra", days.alias("diff_compra_dias")
    ).orderBy("diff_compra_dias", "cliente_id")


def last_purchase_per_client(purchases: DataFrame, cfg: Config) -> DataFrame:
    """The latest valid purchase of each client under each name used."""
    return last_purchase_per_name(valid_purchases(purchases, cfg), cfg).select(
        "cliente_id",
        "nome",
        "email",
        "compra_id",
        "valor",
        F.col("dia").alias("data_ultima_compra"),
        "row_num",
    )


def seller_sales(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Sales count and value per seller; orders without one count 0, their value stays."""
    valid = valid_purchases(purchases, cfg)
    return (
        by_text(valid, "nome_fantasia", "seller", cfg.text_collation)
        .agg(
            *text_label("nome_fantasia", "seller", cfg.text_collation),
            F.count("nome_fantasia").alias("qtd_vendas"),
            total("valor").alias("valor_vendas"),
        )
        .select("seller", "qtd_vendas", "valor_vendas")
        .orderBy(F.desc("valor_vendas"), "seller")
    )


def seller_month(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Sales per seller and month."""
    return _seller_months(purchases, cfg, "mes")


def seller_month_literal(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Sales per seller over all months, next to the first month sold in."""
    return _seller_months(purchases, cfg)


def _seller_months(purchases: DataFrame, cfg: Config, *months: str) -> DataFrame:
    aggs = text_label("nome_fantasia", "seller", cfg.text_collation)
    aggs.append(F.count("dia").alias("venda_seller_mes"))
    if not months:
        aggs.append(F.min("mes").alias("mes"))
    return (
        by_text(
            valid_purchases(purchases, cfg), "nome_fantasia", "seller", cfg.text_collation, *months
        )
        .agg(*aggs)
        .select(month_label(F.col("mes")).alias("mes_ano"), "seller", "venda_seller_mes")
        .orderBy("mes_ano", F.desc("venda_seller_mes"), "seller")
    )


def purchases_rollup(purchases: DataFrame, cfg: Config) -> DataFrame:
    """``recorte, chave, pedidos, valor``: orders and value by month, by seller and in all, in one pass."""
    dims = ("mes", "nome_fantasia")
    aggs = {"pedidos": F.count("compra_id"), "com_seller": F.count("nome_fantasia"), "valor": total("valor")}
    got = by_each(valid_purchases(purchases, cfg), dims, aggs, whole=True)
    by_month, by_seller = (F.col(SET) == set_number(dims, [d]) for d in dims)
    return got.select(
        F.when(by_month, "mes").when(by_seller, "seller").otherwise("total").alias("recorte"),
        F.when(by_month, month_label(F.col("mes"))).when(by_seller, F.col("nome_fantasia")).alias("chave"),
        # a seller's own report counts names
        F.when(by_seller, F.col("com_seller")).otherwise(F.col("pedidos")).alias("pedidos"),
        "valor",
    )


def window_totals(purchases: DataFrame, windows: DataFrame, reports: Sequence[str]) -> DataFrame:
    """``relatorio, pedidos, gmv, compradores`` of valid orders in each report's window, in one plan."""
    valid = in_windows(purchases.where(F.col("status_pedido") == 1), windows, reports)
    return valid.groupBy(REPORT).agg(
        F.count("compra_id").alias("pedidos"),
        total("valor").alias("gmv"),
        F.count_distinct("cliente_id").alias("compradores"),
    )


def buyers_by_window(bitmaps: DataFrame, windows: DataFrame, reports: Sequence[str]) -> DataFrame:
    """``relatorio, clientes``: the buyers of each report's window, from stored bitmaps."""
    return count_distinct_merged(in_windows(bitmaps, windows, reports), [REPORT], "clientes")
