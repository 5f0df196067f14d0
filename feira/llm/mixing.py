"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queue one behind the other, again and again for as many
rounds as a document may repeat. An entry finishes at its virtual time, the words of its source up to and with it
divided by the source's target; all entries are sorted by that time and taken until the budget is used up.
So at every moment each source has given its share, and the mixture can be read in that order.

The budget is the size of all sources. A source's target is its weight's share of the budget, at most
``most_repeats`` times its size; what is above goes to the others by weight, until none is above. With the
sources sorted by the level at which they reach their limit, that is the largest of (budget - limits
so far) / (weights left), so no rounds are needed.

A document's size is its number of words; a null text has none. Documents without words, and sources of such
documents only, are taken zero times. A null source is a source of its own, the last one. The order of documents
is that of a hash of seed and id, then the id (null first), size and number among equal rows: rows that repeat id,
source and size are interchangeable, are one unit until the queue is formed, and each has its own place. Nothing depends on
how rows are stored, so reruns agree. Only the three columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import files, store
from feira.llm.running import running

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Who may weigh what: ``weight`` makes a source's weight (a positive long) from its rank by code point, from 0, null last."""

    weight: Callable[[Column], Column] = lambda rank: rank % 3 + 1
    most_repeats: int = 3
    seed: int = 42


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(units: DataFrame, how: Mix, folder: str) -> DataFrame:
    """``source, rank, source_size, largest, target`` per source, from ``source, size, copies``."""
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.max("size").alias("largest")
    )
    named = sources.select(
        "source", "source_size", "largest", F.col("source").isNull().alias("unnamed"),
        F.coalesce("source", F.lit("")).alias("name"), F.lit(1).cast("long").alias("one"),
    )
    ranked = running(named, [], ["unnamed", "name"], ["one"], f"{folder}/ranks")
    weighed = ranked.select("source", "source_size", "largest", (F.col("one_until") - 1).alias("rank"))
    weighed = store.stored(
        weighed.withColumn("weight", how.weight(F.col("rank")).cast("long"))
        .withColumn("limit", F.col("source_size") * how.most_repeats)
        .withColumn("fills_at", F.col("limit") / F.col("weight")),
        f"{folder}/weighed",
    )
    whole = weighed.agg(F.sum("source_size").alias("budget"), F.sum("weight").alias("all_weights"))  # one row
    filled = running(weighed, [], ["fills_at", "rank"], ["limit", "weight"], f"{folder}/levels").crossJoin(whole)
    left = F.col("all_weights") - F.col("weight_until")
    level = filled.agg(
        F.greatest(
            F.max(F.col("budget") / F.col("all_weights")),
            F.max(F.when(left > 0, (F.col("budget") - F.col("limit_until")) / left)),
        ).alias("level")
    )  # one row
    target = F.least(F.col("weight") * F.col("level"), F.col("limit").cast("double"))
    return weighed.crossJoin(level).select("source", "rank", "source_size", "largest", "weight", target.alias("target"))


#: What decides between entries of one virtual time.
ORDER = ["finish", "rank", "shuffle", "key", "size", "number", "round"]


def queue(df: DataFrame, id_col: str, text_col: str, source_col: str, how: Mix, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` with their place in the queue of their source, and every entry that may be taken, with its ``finish``."""
    work = f"{folder}/work"
    units = store.stored(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(F.col(text_col).cast("string")).alias("size"),
        )
        .groupBy("id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies")),
        f"{work}/units",
    )
    sources = store.stored(targets(units, how, work), f"{work}/sources")
    same = units["source"].eqNullSafe(sources["source"])
    units = units.join(sources, same).select(units["*"], "rank", "source_size", "target")
    shuffled = units.select(
        "*",
        F.substring(F.sha2(F.concat_ws(":", F.lit(how.seed), F.col("id").cast("string")), 256), 1, 16).alias("shuffle"),
        F.coalesce(F.col("id").cast("long"), F.lit(store.NULL_ID)).alias("key"),
        (F.col("size") * F.col("copies")).alias("words"),
    )
    placed = running(shuffled, ["rank"], ["shuffle", "key", "size"], ["words"], f"{work}/places")
    rows = placed.select(
        "id", "source", "size", "source_size", "target", "rank", "shuffle", "key",
        (F.col("words_until") - F.col("words")).alias("start"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("number"),
    )
    rows = store.stored(rows.withColumn("end", F.col("start") + F.col("number") * F.col("size")), f"{folder}/rows")
    # at this time every source has given its target, so no later entry is taken; one row
    latest = sources.where("target > 0").agg((1 + F.max(F.col("largest") / F.col("target"))).alias("latest"))
    entries = (
        rows.where("size > 0")
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(how.most_repeats - 1))))
        .withColumn("finish", finish(F.col("round")))
        .crossJoin(latest)
        .where(F.col("finish") <= F.col("latest") * (1 + 1e-9))
        .select(*ORDER, "id", "source")
    )
    return rows, entries


def finish(turn: Column) -> Column:
    """The virtual time at which a document's entry of a round ends."""
    return (turn * F.col("source_size") + F.col("end")) / F.col("target")


def mix_sources(df: DataFrame, id_col: str, text_col: str, source_col: str, how: Mix = Mix()) -> DataFrame:
    """Per row of ``df``: ``id, source, size, source_size, target`` and ``times``, how often the mixture takes it."""
    folder = store.scratch(df.sparkSession, "mix")
    rows, entries = queue(df, id_col, text_col, source_col, how, folder)
    last = _taken(rows, entries, f"{folder}/work").agg(F.max(F.struct(*ORDER)).alias("last"))  # one row
    last = store.stored(last, f"{folder}/last")
    files.drop(f"{folder}/work")  # the result is read from the two tables that stay

    def taken(turn: int) -> Column:
        here = {"finish": finish(F.lit(turn)), "round": F.lit(turn)}
        key = F.struct(*(here.get(c, F.col(c)).alias(c) for c in ORDER))
        return F.when((F.col("size") > 0) & (key <= F.col("last")), 1).otherwise(0)

    times = sum((taken(k) for k in range(1, how.most_repeats)), taken(0))
    return rows.crossJoin(last).select("id", "source", "size", "source_size", "target", times.cast("long").alias("times"))


def mixture(df: DataFrame, id_col: str, text_col: str, source_col: str, how: Mix = Mix()) -> DataFrame:
    """``id, source, size, round, finish`` of each entry taken; by ``finish`` they are the mixture in its order."""
    folder = store.scratch(df.sparkSession, "mixture")
    rows, entries = queue(df, id_col, text_col, source_col, how, folder)
    return _taken(rows, entries, f"{folder}/work").select("id", "source", "size", "round", "finish")


def _taken(rows: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """The first entries by virtual time, as many as the budget holds."""
    budget = rows.agg(F.sum("size").alias("budget"))  # one row
    ordered = entries.withColumn("amount", F.col("size"))
    return running(ordered, [], ORDER, ["amount"], f"{folder}/entries").crossJoin(budget).where("amount_until <= budget")
