"""Keys that repeat or point nowhere, found while joining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

FAULT_COLUMNS = ("tabela", "problema", "chave", "linhas")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key with its columns, the least by their order, and ``copias``, how many rows the key has.

    Rows without a key are left out: they match nothing.
    """
    rest = [c for c in df.columns if c != key]
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(*rest)).alias("linha"), F.count(F.lit(1)).alias("copias")
    )
    return kept.select(key, *(F.col(f"linha.{c}").alias(c) for c in rest), "copias")


def join_checked(
    facts: DataFrame, dims: DataFrame, fact_key: str, dim_key: str, seen: Observation
) -> DataFrame:
    """``facts`` left-joined with one row per key of ``dims``: a repeated key multiplies nothing.

    ``seen`` holds, once the result has been computed, ``linhas``, ``orfas`` (rows whose key is not in ``dims``), ``repetidas``
    (rows whose key repeats there) and ``mais_copias``; they are counted in the same pass.
    """
    # rebalanced: not laid out by key already, so that a hot key of the facts can be split
    single = one_per_key(dims, dim_key).withColumnRenamed(dim_key, "chave_unica").hint("rebalance")
    joined = facts.join(single, facts[fact_key] == single["chave_unica"], "left")
    counted = joined.observe(
        seen,
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(F.col(fact_key).isNotNull() & F.col("chave_unica").isNull()).alias("orfas"),
        F.count_if(F.col("copias") > 1).alias("repetidas"),
        F.max("copias").alias("mais_copias"),
    )
    return counted.drop("copias")


def key_faults(facts: DataFrame, dims: DataFrame, fact_key: str, dim_key: str, fact_name: str, dim_name: str) -> DataFrame:
    """``tabela, problema, chave, linhas``: keys that repeat in ``dims`` and keys of ``facts`` that are not there.

    Each table is scanned once and counted by key before it is shuffled, so a hot key is one row per task.
    """
    held = dims.where(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias("chave")).agg(F.count(F.lit(1)).alias("copias"))
    used = facts.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("chave")).agg(F.count(F.lit(1)).alias("usos"))
    both = held.join(used, "chave", "full")
    fault = F.when(F.col("copias") > 1, F.struct(F.lit(dim_name).alias("tabela"), F.lit("repetida").alias("problema"), F.col("copias").alias("linhas"))).when(
        F.col("copias").isNull(), F.struct(F.lit(fact_name).alias("tabela"), F.lit("orfa").alias("problema"), F.col("usos").alias("linhas"))
    )
    return both.select("chave", fault.alias("f")).where("f IS NOT NULL").select("f.tabela", "f.problema", "chave", "f.linhas")
