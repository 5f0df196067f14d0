"""Registration reports over the curated customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.config import Config
from feira.functions.text import not_in
from feira.operators.aggregates import count_by, monthly
from feira.operators.breakdowns import count_by_each
from feira.operators.period import in_quarters


def is_active(cfg: Config) -> Column:
    """Condition: active and not deleted."""
    return (F.col("status_cliente") == 1) & not_in(F.col("email"), cfg.deleted_email)


def active_signups(customers: DataFrame, cfg: Config) -> DataFrame:
    """Active customers registered in the sign-up window."""
    return in_quarters(customers, cfg.windows.signups).where(is_active(cfg))


def signups_total(customers: DataFrame, cfg: Config) -> DataFrame:
    signed = in_quarters(customers, cfg.windows.signups)
    return signed.agg(F.count("cliente_id").alias("cadastros_2022"))


def active_signups_total(customers: DataFrame, cfg: Config) -> DataFrame:
    return active_signups(customers, cfg).agg(F.count("cliente_id").alias("cadastros_ativos_2022"))


def active_signups_monthly(
    customers: DataFrame, cfg: Config, keep_month: bool = False
) -> DataFrame:
    """Sorted by the label text, or by calendar when the month is kept."""
    counts = monthly(
        active_signups(customers, cfg),
        "mes",
        F.count("dia").alias("cadastro_ativos_mes"),
        keep_month=keep_month,
    )
    return counts.orderBy("mes" if keep_month else "mes_ano")


def active_clients_by_segment(customers: DataFrame, cfg: Config) -> DataFrame:
    """One row per active client, ordered by segment, then client."""
    return (
        active_signups(customers, cfg)
        .groupBy("cliente_id")
        .agg(
            F.min("nome_completo").alias("nome_completo"),
            F.min("purchase_type").alias("purchase_type"),
        )
        .orderBy("purchase_type", "cliente_id")
    )


def signups_by_segment(customers: DataFrame, cfg: Config) -> DataFrame:
    return count_by(active_signups(customers, cfg), "purchase_type", "tipos_clientes_2022")


def signups_by_cep(customers: DataFrame, cfg: Config) -> DataFrame:
    return _by_place(active_signups(customers, cfg), "cep", cfg)


def signups_by_bairro(customers: DataFrame, cfg: Config) -> DataFrame:
    return _by_place(active_signups(customers, cfg), "bairro", cfg)


def signups_by_cidade(customers: DataFrame, cfg: Config) -> DataFrame:
    """Clients without a city are left out."""
    return _by_place(active_signups(customers, cfg).where("cidade IS NOT NULL"), "cidade", cfg)


def signups_by_estado(customers: DataFrame, cfg: Config) -> DataFrame:
    """Clients without a state or with the invalid one are left out."""
    valid = active_signups(customers, cfg).where(F.col("estado") != cfg.invalid_state)
    return _by_place(valid, "estado", cfg)


def _by_place(df: DataFrame, dim: str, cfg: Config) -> DataFrame:
    name = f"cadastros_{dim}"
    return count_by(df, dim, name, cfg.text_collation).orderBy(F.desc(name), dim)


def signups_breakdowns(customers: DataFrame, cfg: Config) -> DataFrame:
    """``dimensao, valor, clientes``: the five breakdowns in one pass, each as its own report gives it."""
    text = ("cep", "bairro", "cidade", "estado")
    counts = count_by_each(
        active_signups(customers, cfg), ("purchase_type", *text), {d: cfg.text_collation for d in text}
    )
    left_out = ((F.col("dimensao") == "cidade") & F.col("valor").isNull()) | (
        (F.col("dimensao") == "estado") & F.coalesce(F.col("valor") == cfg.invalid_state, F.lit(True))
    )
    return counts.where(~left_out).withColumnRenamed("n", "clientes")
