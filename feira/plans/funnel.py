"""The growth funnel: one row from visits to recent buyers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.config import Config
from feira.operators.period import in_quarters, in_quarters_expr
from feira.plans.signups import is_active
from feira.plans.traffic import app_totals

FUNNEL_COLUMNS = (
    "visitas_2022",
    "downloads_2022",
    "cadastros_2022",
    "cadastros_ativos_2022",
    "qtd_clientes_compraram",
    "qtd_clientes_compraram_quarter",
)


def growth_funnel(
    app: DataFrame, customers: DataFrame, purchases: DataFrame, cfg: Config
) -> DataFrame:
    """Each table is read once; the three one-row results are laid over each other."""
    stages = [app_totals(app), _signup_stage(customers, cfg), _buyer_stage(purchases, cfg)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stages)
    return rows.agg(*(F.max(c).alias(c) for c in FUNNEL_COLUMNS))


def _signup_stage(customers: DataFrame, cfg: Config) -> DataFrame:
    active = F.when(is_active(cfg), F.col("cliente_id"))
    return in_quarters(customers, cfg.windows.signups).agg(
        F.count("cliente_id").alias("cadastros_2022"),
        F.count(active).alias("cadastros_ativos_2022"),
    )


def _buyer_stage(purchases: DataFrame, cfg: Config) -> DataFrame:
    """Exact distinct buyers of both windows from one row of marks per client."""
    w = cfg.windows
    bought = in_quarters(purchases, (*w.funnel_buyers, *w.funnel_last_quarter)).where(
        (F.col("status_pedido") == 1) & F.col("cliente_id").isNotNull()
    )
    marks = bought.groupBy("cliente_id").agg(
        F.max(in_quarters_expr(w.funnel_buyers)).alias("na_janela"),
        F.max(in_quarters_expr(w.funnel_last_quarter)).alias("no_trimestre"),
    )
    return marks.agg(
        F.count_if("na_janela").alias("qtd_clientes_compraram"),
        F.count_if("no_trimestre").alias("qtd_clientes_compraram_quarter"),
    )
