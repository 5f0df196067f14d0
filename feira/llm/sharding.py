"""Sharding by fixed virtual slots, with a versioned slot-to-shard map.

Every record hashes to one of a few thousand slots and never changes it. A map
says which shard holds a slot. Version 0 deals the slots out in turn; bytes are
then summed by slot, and an edit of the map, stored as the next version, moves
the smallest slots of shards above the mean to those below, until the shards are near equal in bytes.
Moving a shard's share is an edit of a few thousand rows whatever the size of the data.

A record's size is its UTF-8 bytes plus one; a null text has none. The slot
comes from id and text, so null or repeated ids with different texts spread;
rows that repeat both are counted, numbered and get a slot for each number, so they spread too. Only id and text are
read. An empty table gives an empty result. Nothing here depends on row order, so any task can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feira.llm import store
from feira.llm.running import running

SLOTS = 4096


def slot_of(id_col: str | Column, text_col: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_col, text_col), F.lit(slots)).cast("int")


def _records(df: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """``id, size, text_crc32, hash, number, vslot`` per row; of rows that repeat id and text only a count is shuffled."""
    body = F.col(text_col).cast("string")
    alike = (
        df.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.col(id_col), body).alias("hash"),
        )
        .groupBy("id", "size", "text_crc32", "hash")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    numbered = alike.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    spread = F.when(F.col("number") == 1, F.col("hash")).otherwise(F.xxhash64("hash", "number"))
    return numbered.withColumn("vslot", F.pmod(spread, F.lit(slots)).cast("int"))


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, bytes, n`` for every slot, empty ones included, from ``vslot, size``."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(used), "vslot", "left").select(  # at most SLOTS rows
        "vslot", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "n"))
    )


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0: slots dealt out in turn."""
    return sizes.select(F.lit(0).alias("version"), "vslot", (F.col("vslot") % shards).cast("int").alias("shard"))


def _split(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """Each slot with ``stays``: whether its shard still holds it within the mean, largest slots first."""
    filling = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    mean = sizes.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    return (
        sizes.join(F.broadcast(current.select("vslot", "shard")), "vslot")
        .withColumn("filled", F.sum("bytes").over(filling))
        .join(F.broadcast(mean))  # one row
        .withColumn("stays", (F.col("shard") < shards) & ((F.col("filled") <= F.col("mean")) | (F.col("bytes") == 0)))
    )


def rebalance(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The next version: slots beyond the mean move, largest first, each to the shard with the fewest bytes.

    The fold runs over at most as many entries as there are slots.
    """
    split = _split(sizes, current, shards)
    kept = F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0))
    loads = [
        F.coalesce(F.sum(F.when((F.col("shard") == k) & F.col("stays"), F.col("bytes"))), F.lit(0)).cast("long")
        for k in range(shards)
    ]
    state = split.agg(
        F.array(*loads).alias("loads"),
        F.sort_array(
            F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot"))), asc=False
        ).alias("moving"),
        kept.alias("kept"),
    )

    def place(acc: Column, slot: Column) -> Column:
        at = F.array_position(acc.loads, F.array_min(acc.loads)).cast("int") - 1
        return F.struct(
            F.transform(
                acc.loads, lambda load, i: F.when(i == at, load + slot.bytes).otherwise(load)
            ).alias("loads"),
            F.concat(
                acc.moved, F.array(F.struct(slot.vslot.alias("vslot"), at.alias("shard")))
            ).alias("moved"),
        )

    start = F.struct(F.col("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("moved"))
    moved = state.select(F.explode(F.aggregate("moving", start, place).moved).alias("m")).select(
        F.col("m.vslot").alias("vslot"), F.col("m.shard").alias("to")
    )
    return split.join(F.broadcast(moved), "vslot", "left").select(  # at most SLOTS rows
        _next(current), "vslot", F.coalesce("to", "shard").alias("shard")
    )


def grow(sizes: DataFrame, current: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard, which takes what the ``shards`` present ones hold beyond the new mean."""
    split = _split(sizes, current, shards + 1)
    return split.select(
        _next(current), "vslot", F.when(F.col("stays"), F.col("shard")).otherwise(shards).cast("int").alias("shard")
    )


def _next(current: DataFrame) -> Column:
    version = current.select(F.max("version")).first()[0]
    return F.lit((version if version is not None else -1) + 1).alias("version")


def _read_map(spark: SparkSession, maps: str, slots: int) -> DataFrame | None:
    """All versions stored in a folder, ``None`` if there are none; a version that was never completed has no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(maps)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    paths = [f"{maps}/{n}" for n in names if n.isdigit()]
    if not paths:
        return None
    versions = spark.read.schema("version int, vslot int, shard int").parquet(*paths)
    counts = [r["count"] for r in versions.groupBy("version").count().collect()]  # a row for each version
    if any(n != slots for n in counts):
        raise ValueError(f"{maps} holds a map of other than {slots} slots")
    return versions if counts else None


def shard_records(
    df: DataFrame, id_col: str, text_col: str, shards: int, slots: int = SLOTS, maps: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Records with their shard and place in it, and the versions of the map.

    ``maps`` is a folder that keeps the versions: its last one is edited and the next one added, by
    one caller at a time. A new folder starts from version 0; without one the map is scratch.

    The records have ``id, size, text_crc32, vslot, shard, place``; places of a
    shard run from 0 without gaps, slot after slot, by id as text in a slot.
    """
    spark = df.sparkSession
    folder = store.scratch(spark, "shards")
    records = store.stored(_records(df, id_col, text_col, slots), f"{folder}/records")
    sizes = store.stored(slot_sizes(records, slots), f"{folder}/sizes")
    maps = (maps or f"{folder}/map").rstrip("/")
    versions = _read_map(spark, maps, slots)
    if versions is None:
        versions = store.stored(first_map(sizes, shards), f"{maps}/0")
    last = versions.agg(F.max("version")).first()[0]
    current = versions.where(F.col("version") == last)
    second = store.stored(rebalance(sizes, current, shards), f"{maps}/{last + 1}")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = second.join(sizes, "vslot").select(
        "vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    keyed = records.select(
        "*", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), F.lit(1).cast("long").alias("one")
    )
    # in ranges of slot and key: neither a slot nor the number of slots bounds the tasks
    numbered = running(keyed, ["vslot"], ["key", "text_crc32", "size", "hash", "number"], ["one"], f"{folder}/places")
    placed = numbered.join(F.broadcast(starts), "vslot").select(  # at most SLOTS rows
        "id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("one_until") - 1).alias("place")
    )
    return placed, versions.unionByName(second)
