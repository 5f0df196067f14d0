"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm import store


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (``a, b``) that is not the least of its component.

    Nodes may be any ordered values; the root is the least. A large star links the
    greater neighbours of a node to its least one, a small star the lesser ones; the two alternate
    until every node hangs on its root. Least neighbours are stored tables, so
    their join lays both sides out anew and a node with very many edges is split.
    """
    current = store.stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{folder}/edges",
    )
    mark, step = _mark(current), 0
    while True:
        step += 1
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store.stored(both.groupBy("a").agg(F.min("b").alias("m")), f"{folder}/large-{step}")
        large = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = store.stored(large, f"{folder}/stars-{step}")
        least = store.stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{folder}/small-{step}")
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = store.stored(
            small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{folder}/edges-{step}"
        )
        before, mark = mark, _mark(current)
        if mark == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
