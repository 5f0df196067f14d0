"""Prefix trie of rebuilt conversations, by fingerprints that compose.

A conversation is rebuilt from the first turns of its base conversation and its own turns after as many. No
rebuilt text is made: a turn counts as its SHA-256 digest, a run of turns as the product of a monoid, its number and a
polynomial of the turns' hashes, and products of neighbouring runs combine into that of both. So the product of
every rebuilt prefix follows from that of the base's head and those of the own turns; conversations longer than a
task are products of pieces.

1. Turns are range-sorted by conversation and turn; each range multiplies up its pieces, and the products of
   the pieces before a piece are put in front of it.
2. A row per conversation and depth has the product of that prefix, that of the prefix one turn shorter, and a
   reference to its last turn. Equal products of one depth are a node of the trie.
3. A node is verified from the references: its members' last turns have one digest and their shorter prefixes
   one product, which was verified at the depth before. A clash makes the whole start again with other multipliers.
4. Sums over subtrees need no walk by depth. A node's smallest member is its representative. A conversation represents
   the nodes of its path from some depth on, so what a conversation adds to a node is all it represents, and for
   the node's own representative what it represents from the node on. A leaf counts for its representative.
5. The ids of conversations that end at a node are range-sorted and packed into pieces of bounded size by every range; the pieces
   of a node then run through one digest in order.

Turns are ordered by turn (null first), then by digest; equal rows are turns of their own. A null role or text counts as
empty. Rows without a conversation belong to none and are left out. Base and head length follow :class:`Rebuild`; a base
that has no rows gives no head. A long text is hashed as a whole, one at a time. Only the four columns are read; an empty
table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import store, text
from feira.llm.running import running

WORD = "[^\\x20\\x09-\\x0D]"
PIECE = 4096  # ids packed at a time

_WORD = text.byte_table(WORD)


@dataclass(frozen=True)
class Rebuild:
    """The base of conversation c is c - c % ``group``; its head has crc32(c) % ``heads`` turns (c in decimal)."""

    group: int = 20
    heads: int = 4

    def base(self, conv: Column) -> Column:
        return conv - conv % self.group

    def head(self, conv: Column) -> Column:
        return (F.crc32(conv.cast("string").cast("binary")) % self.heads).cast("int")


class Products:
    """Products of runs of turns: lanes of polynomials over 64-bit integers with odd multipliers."""

    LANES = 2

    def __init__(self, attempt: int = 0):
        draw = text.mix(np.arange(1, self.LANES + 1, dtype=np.uint64) + np.uint64(1000 * attempt + 7))
        self.times = [int(x) | 1 for x in draw]
        self.back = [pow(x, -1, 1 << 64) for x in self.times]

    def power(self, lane: int, exponents: np.ndarray) -> np.ndarray:
        """The lane's multiplier to each of the exponents, which may be negative."""
        out = np.ones(len(exponents), np.uint64)
        for base, left in ((self.times[lane], exponents.copy()), (self.back[lane], -exponents)):
            left[left < 0] = 0
            while left.any():
                out = np.where(left & 1, out * np.uint64(base), out)
                base, left = base * base % (1 << 64), left >> 1
        return out

    def shifted(self, lane: int, product: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """A run's product when ``turns`` turns are put in front of it."""
        return product * self.power(lane, turns)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _turn_values(digests: pa.Array) -> list[np.ndarray]:
    """The turns' hashes for each lane, from their digests."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(len(digests), 4)
    return [raw[:, k].copy() for k in range(Products.LANES)]


def digest_turn(role: str | None, body: str | None) -> bytes:
    r, t = (role or "").encode(), (body or "").encode()
    return hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest()


def _turns(df: DataFrame, conv: str, turn: str, role: str, body: str) -> DataFrame:
    """``conv, has_turn, turn, digest, words`` per row that has a conversation."""
    rows = df.select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).isNotNull().alias("has_turn"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(body).cast("string").alias("text"),
    ).where("conv IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 4):
                data, offsets = text.text_bytes(part.column(4))
                _, _, at = text.words(data, offsets, _WORD)
                pairs = zip(part.column(3).to_pylist(), part.column(4).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in range(3)),
                        pa.array([digest_turn(r, t) for r, t in pairs], pa.binary()),
                        pa.array(np.diff(at), pa.int64()),
                    ],
                    ["conv", "has_turn", "turn", "digest", "words"],
                )

    return rows.mapInArrow(run, "conv long, has_turn boolean, turn long, digest binary, words long")


def _pieces(turns: DataFrame, how: Products) -> DataFrame:
    """``conv, part, k, f1, f2, digest, words``: each range's turns with their number and the product up to them in the range."""
    order = ["conv", "has_turn", "turn", "digest"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, length, products = None, 0, [np.zeros(1, np.uint64)] * how.LANES
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy()
            first = np.ones(n, bool)
            first[1:] = conv[1:] != conv[:-1]
            first[0] = conv[0] != last
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(first, at, -1))  # -1: goes on from the batch before
            k = np.where(start >= 0, at - start, at + length)
            out = []
            for lane, values in enumerate(_turn_values(batch.column(3))):
                sums = np.cumsum(how.shifted(lane, values, k), dtype=np.uint64)
                before = np.where(start > 0, sums[np.maximum(start, 1) - 1], np.uint64(0))
                before = np.where(start < 0, np.zeros(1, np.uint64) - products[lane], before)
                out.append(sums - before)
            last, length, products = conv[-1], int(k[-1]) + 1, [f[-1:] for f in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(k + 1, pa.int64()),
                    *(_long(f) for f in out),
                    batch.column(3),
                    batch.column(4),
                ],
                ["conv", "part", "k", "f1", "f2", "digest", "words"],
            )

    return ranged.mapInArrow(run, "conv long, part int, k long, f1 long, f2 long, digest binary, words long")


def _fronts(pieces: DataFrame, how: Products) -> DataFrame:
    """``conv, part, turns, g1, g2``: the length and product of all that comes before a conversation's piece."""
    last = F.max(F.struct("k", "f1", "f2")).alias("whole")
    wholes = pieces.groupBy("conv", "part").agg(last).select("conv", "part", "whole.*")
    ordered = wholes.repartition("conv").sortWithinPartitions("conv", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, product = None, 0, [0] * how.LANES
        for batch in batches:
            rows = []
            for c, part, k, *f in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    conv, turns, product = c, 0, [0] * how.LANES
                rows.append((c, part, turns, *(int(np.uint64(p).astype(np.int64)) for p in product)))
                product = [(p + v * pow(t, turns, 1 << 64)) % (1 << 64) for p, v, t in zip(product, f, how.times)]
                turns += k
            names = ["conv", "part", "turns", "g1", "g2"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names
            )

    return ordered.mapInArrow(run, "conv long, part int, turns long, g1 long, g2 long")


def _own(pieces: DataFrame, fronts: DataFrame, how: Products) -> DataFrame:
    """``conv, k, p1, p2, digest, words``: each turn with its number in the conversation and the product up to it."""
    rows = pieces.join(fronts, ["conv", "part"]).select(
        "conv", "k", "f1", "f2", "turns", "g1", "g2", "digest", "words"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(4).to_numpy()
            products = [
                _u64(batch.column(5 + lane)) + how.shifted(lane, _u64(batch.column(2 + lane)), turns)
                for lane in range(how.LANES)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(batch.column(1).to_numpy() + turns),
                    *(_long(p) for p in products),
                    batch.column(7),
                    batch.column(8),
                ],
                ["conv", "k", "p1", "p2", "digest", "words"],
            )

    return rows.mapInArrow(run, "conv long, k long, p1 long, p2 long, digest binary, words long")


def _plans(own: DataFrame, rule: Rebuild) -> DataFrame:
    """Per conversation: ``h`` turns of its own to leave out, the ``head`` it takes from its base, its ``total`` length, and ``cut``, its first h turns' product."""
    most = rule.heads - 1
    turn = F.struct("k", "p1", "p2", "digest", "words")
    starts = own.groupBy("conv").agg(
        F.max("k").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("k") <= most, turn))).alias("first"),  # at most heads - 1
    )
    conv = F.col("conv")
    mine = starts.select("conv", "n", "first", rule.head(conv).alias("h"), rule.base(conv).alias("base"))
    bases = starts.select(conv.alias("base"), F.col("first").alias("of_base"))
    joined = mine.join(bases, "base", "left").withColumn(
        "head", F.when(F.col("of_base").isNotNull(), F.expr("slice(of_base, 1, h)")).otherwise(F.expr("slice(first, 1, 0)"))
    )
    end = F.expr("try_element_at(head, size(head))")
    nothing = F.lit(0).cast("long")
    return joined.select(
        "conv",
        "base",
        "h",
        "head",
        F.expr("if(h > 0, try_element_at(first, h), null)").alias("cut"),
        F.when(F.size("head") > 0, F.struct(end.p1.alias("p1"), end.p2.alias("p2")))
        .otherwise(F.struct(nothing.alias("p1"), nothing.alias("p2")))
        .alias("front"),
        (F.size("head") + F.greatest(nothing, F.col("n") - F.col("h"))).cast("long").alias("total"),
    )


def _prefixes(own: DataFrame, plans: DataFrame, how: Products) -> DataFrame:
    """A row per conversation and depth: ``f1, f2``, the rebuilt prefix's product, ``u1, u2``, that of the one a turn shorter, its last turn, and whether it ``ends``."""
    nothing = F.lit(0).cast("long")
    heads = plans.select("conv", "base", "total", F.posexplode("head").alias("at", "t")).select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), "t.p1", "t.p2",
        *(nothing.alias(c) for c in ("c1", "c2", "b1", "b2", "h", "front")),
        "t.digest", "t.words", "total", F.col("base").alias("ref_conv"), F.col("t.k").alias("ref_k"),
    )
    front = F.size("head").cast("long")
    tails = own.join(plans, "conv").where("k > h").select(
        "conv", (front + F.col("k") - F.col("h")).alias("depth"), "p1", "p2",
        *(F.coalesce(F.col(f"cut.{p}"), nothing).alias(c) for p, c in (("p1", "c1"), ("p2", "c2"))),
        F.col("front.p1").alias("b1"), F.col("front.p2").alias("b2"), F.col("h").cast("long").alias("h"), front.alias("front"),
        "digest", "words", "total", F.col("conv").alias("ref_conv"), F.col("k").alias("ref_k"),
    )
    rows = heads.unionByName(tails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, h, ahead = (batch.column(c).to_numpy() for c in (1, 8, 9))
            out, up = [], []
            for lane, value in enumerate(_turn_values(batch.column(10))):
                # the own turns after h, moved from behind h turns to behind the head
                tail = _u64(batch.column(2 + lane)) - _u64(batch.column(4 + lane))
                product = _u64(batch.column(6 + lane)) + how.shifted(lane, tail, ahead - h)
                out.append(product)
                up.append(product - how.shifted(lane, value, depth - 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(_long(x) for x in (*out, *up)),
                    *(batch.column(c) for c in (10, 11)),
                    pa.array(depth == batch.column(12).to_numpy()),
                    *(batch.column(c) for c in (13, 14)),
                ],
                ["conv", "depth", "f1", "f2", "u1", "u2", "digest", "words", "ends", "ref_conv", "ref_k"],
            )

    return rows.mapInArrow(
        run,
        "conv long, depth long, f1 long, f2 long, u1 long, u2 long, digest binary, words long, ends boolean, ref_conv long, ref_k long",
    )


NODE = ["depth", "f1", "f2"]


def _nodes(rows: DataFrame) -> DataFrame:
    """The nodes below the root: smallest member, members, parent's product, words and reference of the last turn; ``clash`` if members differ."""
    apart = [F.min(c) != F.max(c) for c in ("u1", "u2", "digest")]
    return rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("u1").alias("u1"),
        F.min("u2").alias("u2"),
        F.min("words").alias("words"),
        F.min(F.struct("ref_conv", "ref_k")).alias("ref"),
        (apart[0] | apart[1] | apart[2]).alias("clash"),
    )


def _ends(rows: DataFrame, plans: DataFrame, folder: str) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of the nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    at_root = plans.where("total = 0").select(*(zero.alias(c) for c in NODE), "conv")
    order = [*NODE, "conv"]
    ends = rows.where("ends").select(*order).unionByName(at_root)
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            conv = batch.column(3)
            breaks = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out = []
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), batch.num_rows]):
                for at in range(a, b, PIECE):
                    ids = conv.slice(at, min(PIECE, b - at)).to_pylist()
                    out.append((*keys[at].tolist(), ids[0], ",".join(map(str, ids))))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], [*order, "ids"]
            )

    packed = store.stored(ranged.mapInArrow(pack, "depth long, f1 long, f2 long, conv long, ids string"), f"{folder}/packed")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[j] for r in done], pa.int64()) for j in range(3)), pa.array([r[3] for r in done], pa.string())],
                [*NODE, "ends_sha256"],
            )

        for batch in batches:
            for *key, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield flush()
            done = []
        if node is not None:
            done.append((*node, state.hexdigest()))
            yield flush()

    whole = packed.repartition(*NODE).sortWithinPartitions(*order)
    return whole.mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def _verified_rows(own_of, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans, prefixes and nodes of the first multipliers under which no two prefixes clash."""
    for attempt in count():
        here = f"{folder}/attempt-{attempt}"
        plans, rows = own_of(Products(attempt), here)
        nodes = store.stored(_nodes(rows), f"{here}/nodes")
        if nodes.where("clash").isEmpty():
            return plans, rows, nodes.drop("clash")


def prefix_nodes(
    df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, rule: Rebuild = Rebuild()
) -> DataFrame:
    """The nodes of the trie, the root included.

    Columns: ``conv_id`` (smallest member) and ``depth`` name a node, ``parent_conv_id`` its parent;
    ``n_convs`` members, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256`` of the members that
    end there, and ``ref_conv, ref_turn``, the conversation and the number of the turn that is the node's last.
    """
    spark = df.sparkSession
    store.ship(spark)
    folder = store.scratch(spark, "trie")
    turns = store.stored(_turns(df, conv_col, turn_col, role_col, text_col), f"{folder}/turns")

    def own_of(how: Products, here: str) -> tuple[DataFrame, DataFrame]:
        pieces = store.stored(_pieces(turns, how), f"{here}/pieces")
        own = store.stored(_own(pieces, store.stored(_fronts(pieces, how), f"{here}/fronts"), how), f"{here}/own")
        plans = store.stored(_plans(own, rule), f"{here}/plans")
        return plans, store.stored(_prefixes(own, plans, how), f"{here}/rows")

    plans, rows, nodes = _verified_rows(own_of, folder)
    below = (F.col("depth") - 1).alias("depth")
    children = nodes.groupBy(below, F.col("u1").alias("f1"), F.col("u2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    children = store.stored(children, f"{folder}/children")
    nodes = store.stored(
        nodes.join(children, NODE, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
        .withColumn("up", -F.col("depth")),
        f"{folder}/valued",
    )
    represented = running(nodes, ["conv"], ["up"], ["saved"], f"{folder}/paths")  # from each node on, by representative
    represented = store.stored(represented, f"{folder}/represented")
    alone = nodes.groupBy("conv").agg(
        F.sum("saved").alias("all_saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    alone = store.stored(alone.where("all_saved > 0 OR leaves > 0"), f"{folder}/alone")
    sums = rows.select(*NODE, "conv").join(alone, "conv").groupBy(*NODE).agg(
        F.sum("all_saved").alias("members_saved"), F.sum("leaves").alias("n_leaves")
    )
    ends = _ends(rows, plans, folder)
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    # a row with the least id and the numbers of conversations, leaves and saved words
    whole = plans.agg(F.min("conv").alias("root_conv"), F.count(F.lit(1)).alias("n_convs")).crossJoin(
        nodes.agg(
            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
            F.count_if(F.col("n_children") == 0).alias("leaves"),
            F.count_if(F.col("depth") == 1).alias("n_children"),
        )
    )
    whole = store.stored(whole, f"{folder}/whole")
    ends = store.stored(ends, f"{folder}/ends")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("u1"), F.col("f2").alias("u2"), F.col("conv").alias("parent"))
    parents = store.stored(parents.where("depth > 1"), f"{folder}/parents")
    zero = F.lit(0)
    saved = F.coalesce("members_saved", zero) - F.coalesce("all_saved", zero) + F.col("saved_until")
    body = (
        represented.join(sums, NODE, "left")
        .join(alone.select("conv", "all_saved"), "conv", "left")
        .join(parents, ["depth", "u1", "u2"], "left")
        .join(ends, NODE, "left")
        .crossJoin(whole.select("root_conv"))
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.coalesce("parent", "root_conv").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
            saved.cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
            F.col("ref.ref_conv").alias("ref_conv"),
            F.col("ref.ref_k").alias("ref_turn"),
        )
    )
    root = (
        whole.where("n_convs > 0")
        .withColumn("depth", F.lit(0).cast("long"))
        .join(ends.where("depth = 0").select("depth", "ends_sha256"), "depth", "left")
        .select(
            F.col("root_conv").alias("conv_id"),
            "depth",
            F.lit(None).cast("long").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            F.col("saved_tokens").cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
            F.lit(None).cast("long").alias("ref_conv"),
            F.lit(None).cast("long").alias("ref_turn"),
        )
    )
    return root.unionByName(body)
