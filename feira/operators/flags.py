"""0/1 validity flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.config import Config
from feira.functions.text import collated, not_in


def mark_test_sellers(comercios: DataFrame, cfg: Config) -> DataFrame:
    """Add ``loja_teste``: once per seller rather than once per order."""
    name = F.col("nome_fantasia")
    return comercios.withColumn("loja_teste", name.ilike(cfg.test_seller_pattern))


def flag_valid_orders(df: DataFrame, cfg: Config) -> DataFrame:
    """Add ``status_pedido``: 0 for a cancelled status or a test seller, else 1.

    An order without a status or without a seller is valid. Both tests are
    written so that they cannot be NULL; Catalyst then splits a filter on the
    flag and runs the status half below the seller join.
    """
    cancelled = _is_in(F.col("status"), cfg.cancelled_statuses, cfg)
    valid = F.coalesce(~cancelled, F.lit(True)) & F.coalesce(~F.col("loja_teste"), F.lit(True))
    return df.withColumn("status_pedido", F.when(valid, 1).otherwise(0))


def flag_active_customers(df: DataFrame, cfg: Config, email: str = "email") -> DataFrame:
    """Add ``status_cliente``: 1 for an active client with an undeleted e-mail, else 0."""
    active = _is_in(F.col("status"), (cfg.active_status,), cfg)
    kept = not_in(F.col(email), cfg.deleted_email)
    return df.withColumn("status_cliente", F.when(active & kept, 1).otherwise(0))


def _is_in(text: Column, values: Iterable[str], cfg: Config) -> Column:
    return collated(text, cfg.text_collation).isin(
        *(collated(F.lit(v), cfg.text_collation) for v in values)
    )
