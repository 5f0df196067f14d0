"""Near-duplicates by MinHash, with sequential Bayesian verification.

1. Each text becomes its set of word shingles and a signature of minima. Texts with equal sets form a class with one
   representative, so exact copies never meet each other.
2. Signatures are cut into bands; representatives that share a band meet in a bucket.
3. In a first round each representative is paired with the least leader of its buckets. The links found give components.
4. Buckets that still hold several components are finished without pairing all their members.
   In a small one, members outside its largest component meet members of other components. The large ones that touch
   the same component, the one with most members anywhere, form a group with a centre, the shingles that most of its members have. What distinguishes a member from the centre
   decides its links: members without a common distinction are linked through the one nearest to the centre or not at all.
   Others must share so many distinctions that the first few of them, in one fixed
   order, meet. Members that meet in a distinction of few are paired; those that share one with many form a smaller group with a
   centre of its own, which is finished in the next round. No link is lost and no group is squared.
5. A pair is judged by comparing signatures batch by batch; it is dropped as soon as the posterior
   chance that its similarity reaches the threshold falls below ``miss``. The
   survivors are verified on their full sets.
6. Components of the links are found by alternating stars.

A null text is empty; texts without words have an empty set and are linked with nothing. Null ids
count as the smallest id. Rows that share an id are nodes of their own if their sets differ. Only
the id and text columns are read. Ties in similarity at the threshold are links. A long text is one set, held by one task
at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import files, store, tasks, text
from feira.llm.components import components

WORD = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Similarity:
    """Linked are texts with ``100 * intersection >= percent * union``."""

    words: int = 5
    percent: int = 80
    bands: int = 29
    rows: int = 5
    batch: int = 16  # minima compared at a time
    miss: float = 1e-6  # posterior chance of a link below which a pair is dropped

    @property
    def minima(self) -> int:
        return self.bands * self.rows


#: Buckets of up to this many members are finished by pairs, larger ones by a centre; both lose no link.
SMALL = 32
FEW = 4  # times SMALL: distinctions of up to so many members are finished by pairs
REFERENCES = 9  # members that a centre is taken from; any centre gives the same links
BATCH = 500  # rows of pairs with their sets that a task holds at a time

_WORD = text.byte_table(WORD)


def shingle_sets(col: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text with fewer words is one shingle."""
    data, offsets = text.text_bytes(col)
    starts, ends, at = text.words(data, offsets, _WORD)
    tokens = text.Rolling(data, lower=True).ranges(starts, ends)
    runs = text.shingles(tokens, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(text.mix(text.shingles(tokens[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = text.mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = text.mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@cache
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = text.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (base[:n] | np.uint64(1))[:, None], base[n:][:, None]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of ``n`` hash functions over a set."""
    times, plus = _factors(n)
    least = np.full(n, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 1024):
        values = shingles[None, k : k + 1024] * times
        values += plus
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _described(df: DataFrame, how: Similarity) -> DataFrame:
    """``rid, key, hash, n, h1, h2, sig`` per row of ``rid, key, text, hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 2):
                sets = shingle_sets(part.column(2), how.words)
                digests = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
                sigs = [signature(s, how.minima) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(3),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.array(sigs, pa.list_(pa.int32())),
                    ],
                    ["rid", "key", "hash", "n", "h1", "h2", "sig"],
                )

    return df.mapInArrow(tasks.tidy(run), "rid long, key long, hash long, n long, h1 long, h2 long, sig array<int>")


@cache
def least_matches(how: Similarity) -> list[tuple[int, int]]:
    """Minima compared so far, and the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n give the similarity the density of Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= how.percent / 100
    out = []
    for n in [*range(how.batch, how.minima, how.batch), how.minima]:
        m = 0
        while m < n:
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[above].sum() >= how.miss * density.sum():
                break
            m += 1
        out.append((n, m))
    return out


def _pruned(pairs: DataFrame, nodes: DataFrame, how: Similarity) -> DataFrame:
    """The pairs ``a, b`` that sequential comparison of signatures does not drop."""
    sig = nodes.select("node", "sig")
    rows = (
        pairs.join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
        .join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a")
        .select("a", "b", "sig_a", "sig_b")
    )
    steps = least_matches(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                batch.column(k).flatten().to_numpy().reshape(batch.num_rows, how.minima) for k in (2, 3)
            )
            live = np.arange(batch.num_rows)
            matches, done = np.zeros(batch.num_rows, np.int64), 0
            for n, fewest in steps:
                matches[live] += (a[live, done:n] == b[live, done:n]).sum(1)
                live = live[matches[live] >= fewest]
                done = n
            yield batch.select([0, 1]).take(pa.array(live))

    return rows.mapInArrow(tasks.tidy(run), rows.select("a", "b").schema)


def _sets(df: DataFrame, nodes: DataFrame, how: Similarity) -> DataFrame:
    """``node, shingles`` for the wanted nodes, from the rows ``rid, key, text``."""
    wanted = nodes.select(F.col("node.id").alias("key"), F.col("node.h").alias("h")).distinct()
    rows = df.select("key", "text").join(wanted.hint("merge"), "key")  # as many nodes as near-duplicates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 1):
                sets = shingle_sets(part.column(1), how.words)
                h = part.column(2).to_pylist()
                mine = [k for k, s in enumerate(sets) if digest(s)[0] == h[k]]  # rows that share an id differ
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(mine, pa.int64())),
                        part.column(2).take(pa.array(mine, pa.int64())),
                        pa.array([sets[k].tobytes() for k in mine], pa.binary()),
                    ],
                    ["id", "h", "shingles"],
                )

    found = rows.mapInArrow(tasks.tidy(run), "id long, h long, shingles binary")
    return found.groupBy(F.struct("id", "h").alias("node")).agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    rows = (
        pairs.join(sets.withColumnsRenamed({"node": "b", "shingles": "of_b"}), "b")
        .join(sets.withColumnsRenamed({"node": "a", "shingles": "of_a"}), "a")
        .select("a", "b", "of_a", "of_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[k] = 100 * common >= how.percent * (len(a) + len(b) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return rows.mapInArrow(tasks.tidy(run), pairs.select("a", "b").schema)


def _bands(nodes: DataFrame, how: Similarity) -> DataFrame:
    """``bucket, node`` for each band of each representative."""
    band = F.transform(
        F.sequence(F.lit(0), F.lit(how.bands - 1)),
        lambda k: F.xxhash64(k, F.slice(F.col("sig"), k * how.rows + 1, F.lit(how.rows))),
    )
    return nodes.select("node", F.explode(band).alias("bucket"))


def _first_pairs(live: DataFrame) -> DataFrame:
    """One pair for each node that does not lead its buckets: with the least leader."""
    return (
        live.where(F.col("node") != F.col("leader"))
        .groupBy("node")
        .agg(F.min("leader").alias("a"))
        .select("a", F.col("node").alias("b"))
    )


def _mixed(live: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """``bucket, node, label, main, widest, size`` of the buckets that hold several components.

    ``main`` is the component with most members in the bucket, ``widest`` that with most members anywhere.
    """
    labelled = store.stored(
        live.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label")),
        f"{folder}/labelled",
    )
    everywhere = store.stored(
        roots.groupBy(F.col("root").alias("label")).agg(F.count(F.lit(1)).alias("wide")), f"{folder}/wide"
    )
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).join(everywhere, "label", "left")
    mixed = store.stored(
        sizes.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("labels"),
            F.max(F.struct("n", "label")).alias("largest"),
            F.max(F.struct(F.coalesce("wide", F.lit(0)), "label")).alias("widest"),
            F.sum("n").alias("size"),
        )
        .where("labels > 1")
        .select("bucket", F.col("largest.label").alias("main"), F.col("widest.label").alias("widest"), "size"),
        f"{folder}/mixed",
    )
    return store.stored(labelled.join(mixed, "bucket"), f"{folder}/members")


def _large(members: DataFrame, folder: str) -> DataFrame:
    """``group, node, label``: the members of the large buckets that touch the same widest component."""
    large = members.where(F.col("size") > SMALL).select(F.xxhash64("widest").alias("group"), "node", "label")
    return store.stored(large.distinct(), f"{folder}/groups")


def _small_pairs(members: DataFrame) -> DataFrame:
    """The pairs of different components in small buckets."""
    small = members.where(F.col("size") <= SMALL)
    few = small.where(F.col("label") != F.col("main")).select(
        "bucket", F.col("node").alias("few"), F.col("label").alias("few_label")
    )
    met = small.join(few, "bucket").where(
        (F.col("label") != F.col("few_label")) & ((F.col("label") == F.col("main")) | (F.col("few") < F.col("node")))
    )
    return met.select(F.least("few", "node").alias("a"), F.greatest("few", "node").alias("b")).distinct()


def _centres(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``group, seen, times, refs``: the shingles of a few members of each group and how many of these have each."""
    picks = groups.groupBy("group").agg(
        F.array(*(F.min_by("node", F.xxhash64(F.lit(k), "node")) for k in range(REFERENCES))).alias("picks")
    )
    rows = (
        picks.select("group", F.explode(F.array_distinct("picks")).alias("node"))
        .join(sets, "node")
        .groupBy("group")
        .agg(F.collect_list("shingles").alias("of"))  # at most REFERENCES
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, times, refs = [], [], []
            for k in range(batch.num_rows):
                of = [np.frombuffer(o.as_buffer(), np.uint64) for o in batch.column(1)[k].values]
                held, count = np.unique(np.concatenate(of), return_counts=True)
                seen.append(held.tobytes())
                times.append(count.astype(np.uint8).tobytes())
                refs.append(len(of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(seen, pa.binary()), pa.array(times, pa.binary()), pa.array(refs, pa.int32())],
                ["group", "seen", "times", "refs"],
            )

    return rows.mapInArrow(tasks.tidy(run), "group long, seen binary, times binary, refs int")


def _distinctions(groups: DataFrame, sets: DataFrame, how: Similarity, folder: str) -> DataFrame:
    """Per row of ``group, node, label``: its ``weight`` against the group's centre and ``first``, what first distinguishes it.

    The centre is the set of shingles that at least half of REFERENCES members have; a distinction is a
    shingle that only one of member and centre has. Two members without a common
    distinction are linked if and only if their weights add up to at most ``slack``; a common one
    only makes them more alike. So all links without a common distinction run through the member of least weight.

    With t the threshold, a linked pair differs in at most (1 - t) / t of the shingles of either member, so
    that many distinctions and one more are enough for the first. Those that few references share come first, so
    that few meet.
    """
    centres = store.stored(_centres(groups, sets), f"{folder}/centres")
    rows = (
        groups.join(sets.withColumnRenamed("shingles", "own"), "node")
        .join(centres, "group")
        .select("group", "node", "label", "own", "seen", "times", "refs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, slacks, counts, firsts = [], [], [], []
            for k, refs in enumerate(batch.column(6).to_pylist()):
                own, seen = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (3, 4))
                times = np.frombuffer(batch.column(5)[k].as_buffer(), np.uint8)
                held = 2 * times.astype(np.int64) >= refs
                has = np.isin(seen, own, assume_unique=True)
                rare = np.setdiff1d(own, seen, assume_unique=True)  # of no reference
                added, gone = has & ~held, held & ~has
                # how many references share it; among equals, additions are rarer than losses
                shared = np.concatenate([np.zeros(len(rare), np.int64), 2 * times[added], 2 * (refs - times[gone].astype(np.int64)) + 1])
                elements = np.concatenate([rare, seen[added], text.mix(seen[gone] ^ np.uint64(1))])
                most = (100 - how.percent) * len(own) // how.percent
                first = elements[np.lexsort((elements, shared))][: most + 1]
                n_gone = int(gone.sum())
                weights.append(100 * n_gone + how.percent * (len(elements) - n_gone))
                slacks.append((100 - how.percent) * int(held.sum()))
                counts.append(len(elements))
                firsts.append(first.view(np.int64))
            longs = [pa.array(x, pa.int64()) for x in (weights, slacks, counts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (0, 1, 2)), *longs, pa.array(firsts, pa.list_(pa.int64()))],
                ["group", "node", "label", "weight", "slack", "differs", "first"],
            )

    kind = rows.schema["node"].dataType.simpleString()
    return rows.mapInArrow(
        tasks.tidy(run),
        f"group long, node {kind}, label {kind}, weight long, slack long, differs long, first array<long>",
    )


def _nearest(found: DataFrame, folder: str) -> DataFrame:
    """The members with their group's member of least weight: ``centre``, its ``least`` weight and whether they are surely linked with it."""
    least = found.groupBy("group").agg(F.min(F.struct("weight", "node")).alias("least"))
    least = store.stored(least.select("group", "least.*").toDF("group", "least", "centre"), f"{folder}/least")
    return found.join(least, "group").withColumn("sure", F.col("weight") + F.col("least") <= F.col("slack"))


def _centre_links(near: DataFrame) -> DataFrame:
    """``a, b``: each group's member of least weight with all that it is sure to be linked with."""
    sure = near.where(F.col("sure") & (F.col("node") != F.col("centre")))
    return sure.select(F.col("centre").alias("a"), F.col("node").alias("b"))


def _shared_elements(near: DataFrame, how: Similarity, folder: str) -> DataFrame:
    """The distinctions in whose place members of several components may be linked; ``met`` is the number of members with them.

    With s common distinctions, two members are linked if their weights add up to at most ``slack + (100 + percent) * s``.
    So the first common one leaves enough of both only if the weight of each is at most the ``limit`` of the other. A prefix
    ends where that can hold for no partner: one that is not sure of the centre weighs more than
    ``slack - least``, any other ``least`` at least, and as much as the distinctions it shares. Then the
    members of each distinction are held against the lightest and the farthest reaching ones that share it.
    """
    weight, over = F.col("weight"), 100 + how.percent

    def up(amount: Column, by: int) -> Column:
        return F.ceil(amount / by)

    apart = up(weight - F.col("least") + 1, over)
    any_member = F.greatest(F.lit(1), up(weight + F.col("least") - F.col("slack"), over), up(weight - F.col("slack"), 100))
    needed = F.when(F.col("sure"), apart).otherwise(F.least(apart, any_member))
    prefix = F.slice("first", F.lit(1), F.greatest(F.lit(0), F.col("differs") - needed + 1).cast("int"))
    limit = F.col("slack") + over * (F.col("differs") - F.col("place")) - weight
    # dealt out by node first: the members of one large bucket may lie in a few files
    elements = (
        near.select("group", "node", "label", "weight", "slack", "differs", "sure", prefix.alias("prefix"))
        .repartition("node")
        .select(
            *("group", "node", "label", "weight", "slack", "differs", "sure"),
            F.posexplode("prefix").alias("place", "element"),
        )
        .select("group", "element", "node", "label", "weight", "sure", limit.alias("limit"))
    )
    elements = store.stored(elements, f"{folder}/elements")

    def of(sure: bool, c: str) -> Column:
        return F.when(F.col("sure") if sure else ~F.col("sure"), F.col(c))

    bounds = (
        elements.groupBy("group", "element")
        .agg(
            F.min("label").alias("one"),
            F.max("label").alias("other"),
            F.min(of(True, "weight")).alias("sure_weight"),
            F.max(of(True, "limit")).alias("sure_limit"),
            F.min(of(False, "weight")).alias("free_weight"),
            F.max(of(False, "limit")).alias("free_limit"),
        )
        .where("one != other AND free_weight IS NOT NULL")
        .drop("one", "other")
    )
    bounds = store.stored(bounds, f"{folder}/bounds")
    useful = (
        elements.join(bounds, ["group", "element"])
        .where(
            "(limit >= free_weight AND weight <= free_limit)"
            " OR (NOT sure AND coalesce(limit >= sure_weight AND weight <= sure_limit, false))"
        )
        .select(*elements.columns)
    )
    useful = store.stored(useful, f"{folder}/useful")
    shared = (
        useful.groupBy("group", "element")
        .agg(
            F.count(F.lit(1)).alias("met"),
            F.min("label").alias("one"),
            F.max("label").alias("other"),
            F.bool_and("sure").alias("all_sure"),
        )
        .where("one != other AND NOT all_sure")
        .select("group", "element", "met")
    )
    shared = store.stored(shared, f"{folder}/shared")
    return store.stored(useful.join(shared, ["group", "element"]), f"{folder}/met")


def _prefix_pairs(met: DataFrame, how: Similarity) -> DataFrame:
    """The pairs of different components that meet in a distinction of few members and may share enough of those after it."""
    elements = met.where(F.col("met") <= FEW * SMALL)
    lighter = elements.select(
        "group", "element", *(F.col(c).alias(f"lighter_{c}") for c in ("node", "label", "weight", "limit", "sure"))
    )
    pairs = elements.join(lighter, ["group", "element"]).where(
        (F.col("label") != F.col("lighter_label"))
        & ~(F.col("sure") & F.col("lighter_sure"))
        & (F.struct("lighter_weight", "lighter_node") < F.struct("weight", "node"))
        & (F.col("weight") <= F.col("lighter_limit"))
        & (F.col("lighter_weight") <= F.col("limit"))
    )
    return pairs.select(F.least("lighter_node", "node").alias("a"), F.greatest("lighter_node", "node").alias("b")).distinct()


def _next_groups(met: DataFrame, folder: str) -> DataFrame:
    """``group, node``: a group of its own for the members that share a distinction with many; equal groups once."""
    hot = store.stored(
        met.where(F.col("met") > FEW * SMALL).select(F.xxhash64("group", "element").alias("group"), "node"), f"{folder}/hot"
    )
    alike = (
        hot.groupBy("group")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
        )
        .groupBy("n", "x", "y")
        .agg(F.min("group").alias("group"))
    )
    return hot.join(store.stored(alike.select("group"), f"{folder}/alike"), "group", "left_semi")


def _labelled(groups: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """``group, node, label`` of the groups that hold several components."""
    labelled = store.stored(
        groups.join(roots, "node", "left").select("group", "node", F.coalesce("root", "node").alias("label")),
        f"{folder}/labelled",
    )
    mixed = labelled.groupBy("group").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed")
    return store.stored(labelled.join(store.stored(mixed.select("group"), f"{folder}/mixed"), "group"), f"{folder}/groups")


def _finished(
    groups: DataFrame, links: DataFrame, sets: DataFrame, nodes: DataFrame, how: Similarity, folder: str
) -> DataFrame:
    """``links``, and those that join components inside the groups (``group, node, label``) into what they should be.

    A group whose members share a distinction lies inside the one it comes from and is smaller, since what all
    references have is in the centre; so the rounds end. A round makes a row for each distinction in a member's prefix.
    """
    step = 0
    while True:
        here = f"{folder}/round-{step}"
        found = store.stored(_distinctions(groups, sets, how, here), f"{here}/found")
        near = _nearest(found, here)
        met = _shared_elements(near, how, here)
        rest = store.stored(_pruned(_prefix_pairs(met, how), nodes, how), f"{here}/rest")
        more = _centre_links(near).union(_verified(rest, sets, how))
        links = links.union(store.stored(more, f"{here}/links"))
        following = store.stored(_next_groups(met, here), f"{here}/next")
        if following.isEmpty():
            return links
        groups = _labelled(following, components(links, f"{here}/components"), here)
        if groups.isEmpty():
            return links
        step += 1


def link(df: DataFrame, id_col: str, text_col: str, how: Similarity, hash_col: str | None = None) -> DataFrame:
    """Per row of ``df``: ``rid`` (its id), ``key`` (never null), ``hash``, ``n`` shingles, and ``root``, the least key reachable."""
    spark = df.sparkSession
    store.ship(spark)
    folder = store.scratch(spark, "minhash")
    rows = df.select(
        F.col(id_col).cast("long").alias("rid"),
        store.row_id(id_col).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        (F.col(hash_col) if hash_col else F.lit(0)).cast("long").alias("hash"),
    )
    described = store.stored(_described(rows, how), f"{folder}/described")
    work = f"{folder}/work"
    classes = store.stored(
        described.where("n > 0").groupBy("h1", "h2").agg(F.min("key").alias("key")), f"{work}/classes"
    )
    node: Column = F.struct(F.col("key").alias("id"), F.col("h1").alias("h"))
    # joined on the key too: only the rows of the representative match, so a class with many copies is no hot key
    nodes = store.stored(
        described.join(classes, ["h1", "h2", "key"], "left_semi").select(node.alias("node"), "sig").dropDuplicates(["node"]),
        f"{work}/nodes",
    )
    bands = _bands(nodes, how)
    led = store.stored(
        bands.groupBy("bucket")
        .agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        f"{work}/led",
    )
    live = store.stored(bands.join(led, "bucket"), f"{work}/live")
    sets = store.stored(_sets(rows, live.select("node"), how), f"{work}/sets")
    with store.small_batches(spark, BATCH):
        first = store.stored(_pruned(_first_pairs(live), nodes, how), f"{work}/first")
        links = store.stored(_verified(first, sets, how), f"{work}/links-1")
        roots = components(links, f"{work}/components-1")
        # links through the centres first: they leave fewer components, and so fewer groups
        groups = _large(_mixed(live, roots, f"{work}/before"), f"{work}/before")
        found = store.stored(_distinctions(groups, sets, how, f"{work}/before"), f"{work}/before/found")
        sure = store.stored(_centre_links(_nearest(found, f"{work}/before")), f"{work}/before/links")
        links = links.union(sure)
        members = _mixed(live, components(links, f"{work}/components-2"), work)
        few = store.stored(_pruned(_small_pairs(members), nodes, how), f"{work}/few")
        links = links.union(store.stored(_verified(few, sets, how), f"{work}/links-2"))
        groups = _large(members, work)
        links = _finished(groups, links, sets, nodes, how, work)
    roots = components(links, f"{work}/components-3")
    labels = store.stored(
        classes.select("h1", "h2", node.alias("node"))
        .join(roots, "node", "left")
        .select("h1", "h2", F.coalesce(F.col("root.id"), F.col("node.id")).alias("root")),
        f"{folder}/labels",
    )
    files.drop(work)  # the result is read from the two tables that stay
    return (
        described.select("rid", "key", "hash", "n", "h1", "h2")
        .join(labels, ["h1", "h2"], "left")
        .select("rid", "key", "hash", "n", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("key")).alias("root"))
    )


def annotate(df: DataFrame, id_col: str, text_col: str, how: Similarity) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the least id reachable) and ``kept`` (the id is that one)."""
    return link(df, id_col, text_col, how).select(
        F.col("rid").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("root") != store.NULL_ID, F.col("root")).alias("component_id"),
        (F.col("key") == F.col("root")).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str, text_col: str, how: Similarity) -> DataFrame:
    """One row of each component, with its columns as they are: of the least id, and among its rows the one of least hash.

    A row that is there several times stays once. Texts without words are all kept.
    """
    names = df.columns
    folder = store.scratch(df.sparkSession, "keep-one")
    # columns are carried by place, so that no name can clash
    held = df.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"))
    rid, body = (F.col(f"row.c{names.index(c)}") for c in (id_col, text_col))
    held = held.select("row", rid.alias("rid"), body.alias("body"), F.xxhash64("row").alias("hash"))
    linked = store.stored(link(held, "rid", "body", how, "hash"), f"{folder}/linked")
    groups = linked.where("n > 0").groupBy("root").agg(F.min(F.struct("key", "hash")).alias("best"))
    best = groups.select("best.*", F.lit(True).alias("won"))
    counts = linked.groupBy("key", "hash", (F.col("n") == 0).alias("empty")).agg(F.count(F.lit(1)).alias("copies"))
    winners = store.stored(
        counts.join(best, ["key", "hash"], "left")
        .where(F.col("empty") | F.col("won"))
        .select("key", "hash", (F.col("empty") | (F.col("copies") == 1)).alias("once")),
        f"{folder}/winners",
    )
    keyed = held.withColumn("key", store.row_id("rid")).select("row", "key", "hash")
    single = keyed.join(winners.where("once"), ["key", "hash"], "left_semi")
    copied = keyed.join(winners.where("not once"), ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"])
    kept = single.select("row").union(copied.select("row"))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
