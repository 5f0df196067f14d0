"""Changes between a stored table and a fresh one, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.operators.tables import PERIOD_FOLDERS
from feira.operators.versions import Period, row_marks

KEY, WAS, NOW = "chave", "antes", "agora"


def changes_by_key(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``chave``, ``antes`` and ``agora`` of the keys whose row is new, gone or different.

    ``antes`` is the quarter the stored row lies in, ``agora`` the fresh row; either is null where there is none. Of
    the stored rows only key, quarter and two hashes are shuffled. Keys are unique in both tables.
    """
    columns = stored.columns
    quarter = F.struct(*PERIOD_FOLDERS)
    old = stored.select(F.col(key).alias(KEY), quarter.alias(WAS), F.struct(*row_marks(columns)).alias("marca_antes"))
    new = fresh.select(F.col(key).alias(KEY), F.struct(*columns).alias(NOW), F.struct(*row_marks(columns)).alias("marca_agora"))
    both = old.join(new, KEY, "full")
    return both.where(~F.col("marca_antes").eqNullSafe(F.col("marca_agora"))).select(KEY, WAS, NOW)


def touched_quarters(changes: DataFrame) -> set[Period]:
    """The quarters in which rows go, come or change: a row per quarter comes to the driver."""
    quarters = changes.select(F.explode(F.array(WAS, F.when(F.col(NOW).isNotNull(), _quarter_now()))).alias("q"))
    found = quarters.where("q IS NOT NULL").select("q.*").distinct()
    return {(r.ano, r.trimestre) for r in found.collect()}


def _quarter_now():
    return F.struct(*(F.col(f"{NOW}.{c}").alias(c) for c in PERIOD_FOLDERS))


def merged(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key did not change, and the fresh rows of those that did."""
    same = stored.join(changes.select(F.col(KEY).alias(key)), key, "left_anti").select(*stored.columns)
    return same.unionByName(changes.where(F.col(NOW).isNotNull()).select(f"{NOW}.*"))
