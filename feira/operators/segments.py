"""Customer segmentation from e-mail lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.config import Config


def segment_lists(segments: DataFrame, cfg: Config) -> DataFrame:
    """One row per lower-case e-mail with ``atacadista`` and ``minimercado`` marks.

    An e-mail listed twice must not multiply customers, hence the grouping.
    """
    segment = F.col("segment")
    return (
        segments.groupBy(F.lower("email").alias("lista_email"))
        .agg(
            F.max(segment == cfg.wholesale).alias("atacadista"),
            F.max(segment == cfg.minimarket).alias("minimercado"),
        )
    )


def segment_customers(clientes: DataFrame, segments: DataFrame, cfg: Config) -> DataFrame:
    """Add ``purchase_type``.

    Wholesale for a listed e-mail or a client without a personal tax number,
    then minimarket for a listed e-mail, then retail. The lists are a table: a
    short one is broadcast by Catalyst's own size check. A long one shuffles
    the clients by e-mail, where all deleted ones share a key. AQE splits it,
    because the rebalanced list does not count as laid out by e-mail already;
    it still counts as unique, so a report without segments drops the join.
    """
    lists = segment_lists(segments, cfg).hint("rebalance")
    same = F.lower(clientes["email"]) == lists["lista_email"]
    purchase_type = (
        F.when(F.col("atacadista") | F.col("cpf").isNull(), cfg.wholesale)
        .when(F.col("minimercado"), cfg.minimarket)
        .otherwise(cfg.retail)
    )
    joined = clientes.join(lists, same, "left").withColumn("purchase_type", purchase_type)
    return joined.drop("lista_email", "atacadista", "minimercado")
