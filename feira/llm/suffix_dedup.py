"""Exact substring dedup with a suffix array over all texts.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier
(smaller id, or same text and earlier start) is removed. Strings are judged on the input.

0. A text that equals a whole earlier one, and every string of it, starts earlier: all its bytes go without sorting its suffixes.
1. Of all suffixes only those at anchors are sorted. The anchor of a string is its least-hashed run of LEAD
   bytes, so equal strings have their anchors at the same place, and an anchor stands for the
   few strings around it. Anchors whose lead occurs once begin no repeat; they are
   left out by counting the leads, of which a task sends a frequent one twice.
2. Each remaining anchor becomes a record with the bytes of its strings. Spark samples splitters and
   range-partitions the records by their leading bytes, ties by id and place, so a lead with very
   many suffixes is spread over several partitions.
3. A bucket, one batch of a sorted partition, is ordered locally by multikey quicksort on 64-bit words. First whole records:
   equal ones are repeats of the earliest. Where a lead has different records, their single strings are ordered the same way.
4. A lead at the edge of a bucket may go on in the next. Its earliest strings are compared
   across boundaries by their bytes, one row for each string and bucket.

A null text is empty, a null id is the smallest. Rows that repeat id and text are one document and each gets
the same result; texts that share an id are ordered by a hash of the text. Texts under LENGTH bytes stay whole. Only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feira.llm import store, text
from feira.llm.sorting import multikey_order

LENGTH = 100
LEAD = 32
REACH = LENGTH - LEAD + 1  # places at which a string's anchor can be
SLICE = 3 << 20
SEEN = 8 << 20  # leads that a task remembers


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of all strings of LENGTH bytes: text, first and last string, place, and hash of the lead.

    Among equal hashes the leftmost counts. An anchor serves strings that start in a row.
    """
    n = len(data)
    if n < LENGTH:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    lead = text.Rolling(data).windows(LEAD)
    least = (lead >> np.uint64(32) << np.uint64(32)) | np.arange(len(lead), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[REACH - width : REACH - width + n - LENGTH + 1])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= LENGTH
    edges[offsets[:-1][long]] += 1
    edges[offsets[1:][long] - LENGTH + 1] -= 1
    valid = np.cumsum(edges[: len(place)], dtype=np.int8) > 0
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & change)
    stop = np.ones(len(place), bool)
    stop[:-1] = (place[1:] != place[:-1]) | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    at = place[first]
    return np.searchsorted(offsets, first, "right") - 1, first, last, at, lead[at]


class _Seen:
    """Leads that a task has met, in sorted runs of growing size; it forgets all beyond ``SEEN`` of them."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def holds(self, leads: np.ndarray) -> np.ndarray:
        found = np.zeros(len(leads), bool)
        for run in self.runs:
            found |= run[np.minimum(np.searchsorted(run, leads), len(run) - 1)] == leads
        return found

    def add(self, leads: np.ndarray) -> None:
        if not len(leads):
            return
        if sum(map(len, self.runs)) > SEEN:
            self.runs = []
        self.runs.append(leads)
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]))]


def _leads(df: DataFrame) -> DataFrame:
    """``did, at, lead, sure`` of all anchors of ``did, text``; ``sure``: the task itself has met the lead before or twice in a slice.

    ``did`` may be any key; texts that share one get the places of both. A lead that a task meets again is told to
    the others once, by a row without ``did``: so however frequent a lead is, it has two rows that are not sure from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told = _Seen(), _Seen()
        for batch in batches:
            for part in text.slices(batch, 1, SLICE):
                data, offsets = text.text_bytes(part.column(1))
                whose, _, _, at, lead = anchors(data, offsets)
                each, first, back, count = np.unique(lead, return_index=True, return_inverse=True, return_counts=True)
                again = seen.holds(each)
                sure = (again | (count > 1))[back]
                tell = each[again]
                tell = tell[~told.holds(tell)]
                seen.add(each[~again])
                told.add(tell)
                rows = np.concatenate([np.flatnonzero(sure), first[~again]])
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(ids[whose[rows]]), pa.nulls(len(tell), pa.int64())]),
                        pa.array(np.append((at - offsets[whose])[rows], np.zeros(len(tell), np.int64))),
                        pa.array(np.append(lead[rows], tell).view(np.int64)),
                        pa.array(np.arange(len(rows) + len(tell)) < sure.sum()),
                    ],
                    ["did", "at", "lead", "sure"],
                )

    return df.mapInArrow(run, "did long, at long, lead long, sure boolean")


def _repeated(leads: DataFrame) -> DataFrame:
    """``did, places``: the anchors of each text whose lead may occur twice."""
    meet = F.when(F.col("sure"), F.xxhash64("did")).otherwise(F.col("lead"))
    # of one lead, at most two rows for each task come together here
    counted = leads.withColumn("meet", meet).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("meet", "sure"))
    )
    kept = counted.where(F.col("did").isNotNull() & (F.col("sure") | (F.col("n") > 1)))
    return kept.groupBy("did").agg(F.collect_set("at").alias("places"))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow column."""
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[index].tobytes())]
    )


def _records(df: DataFrame) -> DataFrame:
    """``did, h, at, back, span, blob`` per remaining anchor: its place, how far back its first string starts, how many strings, their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 2, SLICE):
                data, offsets = text.text_bytes(part.column(2))
                whose, first, last, at, _ = anchors(data, offsets)
                places = part.column(3)
                wanted = np.repeat(offsets[:-1], np.diff(places.offsets.to_numpy())) + places.flatten().to_numpy()
                keep = np.isin(at, wanted)
                whose, first, last, at = whose[keep], first[keep], last[keep], at[keep]
                for k in range(0, len(at), RECORDS):
                    w, f, e, a = whose[k : k + RECORDS], first[k : k + RECORDS], last[k : k + RECORDS], at[k : k + RECORDS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(w)),
                            part.column(1).take(pa.array(w)),
                            pa.array(a - offsets[w]),
                            pa.array((a - f).astype(np.int32)),
                            pa.array((e - f + 1).astype(np.int32)),
                            _gather(data, f, e - f + LENGTH),
                        ],
                        ["did", "h", "at", "back", "span", "blob"],
                    )

    return df.mapInArrow(run, "did long, h long, at long, back int, span int, blob binary")


RECORDS = 20_000


class _Words:
    """64-bit words of byte ranges, as characters of a string; past the end they are 0."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.last = len(data)
        self.view = np.ndarray((len(data) + 1,), ">u8", padded.tobytes(), strides=(1,))

    def at(self, starts: np.ndarray, sizes: np.ndarray, d: int) -> np.ndarray:
        left = np.clip(sizes - 8 * d, 0, 8)
        word = self.view[np.minimum(starts + 8 * d, self.last)].astype(np.uint64)
        cut = (8 * (8 - left)).astype(np.uint64)
        return np.where(left > 0, word >> cut << cut, np.uint64(0))


def _classes(common: np.ndarray, depth: int, order: np.ndarray) -> np.ndarray:
    """By item: the first item of its run of equal strings."""
    heads = common < depth
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(heads)][np.cumsum(heads) - 1] if len(order) else order
    return first


def repeats(did: np.ndarray, h: np.ndarray, at: np.ndarray, back: np.ndarray, span: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a bucket of sorted records shows: removed spans, and the earliest strings of the leads at its edges.

    Spans are record, start and stop; strings are record, start and place in ``data``.
    """
    n = len(did)
    words, starts, sizes = _Words(data), offsets[:-1], np.diff(offsets)
    every = np.arange(n)
    same = np.zeros(n, bool)
    if n > 1:
        lead = [words.at(starts + back, np.full(n, LEAD), d) for d in range(LEAD // 8)]
        same[1:] = np.logical_and.reduce([w[1:] == w[:-1] for w in lead])
    group = np.cumsum(~same) - 1
    shape = (back.astype(np.int64) << 16 | span).astype(np.uint64)

    def record_key(d: int, items: np.ndarray) -> np.ndarray:
        if d == 0:
            return group[items].astype(np.uint64)
        return shape[items] if d == 1 else words.at(starts[items], sizes[items], d - 2)

    depth = 2 + (int(sizes.max()) + 7) // 8
    order, common = multikey_order(record_key, n, depth)
    head = _classes(common, depth, order)
    later = (did != did[head]) | (h != h[head]) | (at != at[head])
    out = [(every[later], (at - back)[later], (at - back + span + LENGTH - 1)[later])]

    firsts = np.flatnonzero(head == every)
    kinds = np.bincount(group[firsts], minlength=group[-1] + 1)
    edge = (group == 0) | (group == group[-1])
    firsts = firsts[(kinds[group[firsts]] > 1) | edge[firsts]]
    record = np.repeat(firsts, span[firsts])
    step = np.arange(len(record)) - np.repeat(np.cumsum(span[firsts]) - span[firsts], span[firsts])
    begin = (at - back)[record] + step
    where = starts[record] + step
    offset = (back[record] - step).astype(np.uint64)
    full = np.full(len(record), LENGTH)

    def string_key(d: int, items: np.ndarray) -> np.ndarray:
        if d == 0:
            return group[record[items]].astype(np.uint64)
        return offset[items] if d == 1 else words.at(where[items], full[items], d - 2)

    depth = 2 + (LENGTH + 7) // 8
    order, common = multikey_order(string_key, len(record), depth)
    head = _classes(common, depth, order)
    later = (did[record] != did[record[head]]) | (h[record] != h[record[head]]) | (begin != begin[head])
    gone = np.flatnonzero(later)
    if len(gone):
        new = np.ones(len(gone), bool)
        new[1:] = (np.diff(gone) != 1) | (record[gone[1:]] != record[gone[:-1]])
        a, b = gone[new], gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
        out.append((record[a], begin[a], begin[b] + LENGTH))
    open_ = np.flatnonzero((head == np.arange(len(record))) & edge[record])
    spans = tuple(np.concatenate(x) for x in zip(*out))
    return *spans, record[open_], begin[open_], where[open_]


def _found(records: DataFrame) -> DataFrame:
    """``did, h, start, stop, string``: removed spans, and with ``string`` what is still to be compared across buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            did, h, at, back, span = (batch.column(k).to_numpy() for k in range(5))
            data, offsets = text.text_bytes(batch.column(5))
            rec, start, stop, open_rec, open_start, where = repeats(
                did, h, at, back.astype(np.int64), span.astype(np.int64), data, offsets
            )
            strings = _gather(data, where, np.full(len(where), LENGTH))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([did[rec], did[open_rec]])),
                    pa.array(np.concatenate([h[rec], h[open_rec]])),
                    pa.array(np.concatenate([start, open_start])),
                    pa.array(np.concatenate([stop, open_start + LENGTH])),
                    pa.concat_arrays([pa.nulls(len(rec), pa.binary()), strings]),
                ],
                ["did", "h", "start", "stop", "string"],
            )

    return records.mapInArrow(run, "did long, h long, start long, stop long, string binary")


def _light(df: DataFrame, folder: str) -> DataFrame:
    """``did, h, h2, n``: each row's id, a hash and the SHA-256 digest of its text, and its length."""
    other = F.sha2(F.col("text").cast("binary"), 256)
    return store.stored(
        df.select("did", "h", other.alias("h2"), F.octet_length("text").cast("long").alias("n")), f"{folder}/texts"
    )


def _once(df: DataFrame, light: DataFrame, folder: str) -> DataFrame:
    """``did, h, text`` with one row of those that repeat id and text.

    Only rows that repeat meet in a shuffle, one text of each from a task.
    """
    names = ["did", "h", "h2", "n"]
    # stored, so that the joins lay this side out themselves and can split a row with many repeats
    again = store.stored(
        light.groupBy(*names).count().where("count > 1").select("did", "h").distinct(), f"{folder}/again"
    )
    if again.isEmpty():
        return df
    alone = df.join(again, ["did", "h"], "left_anti")
    one = df.join(again, ["did", "h"], "left_semi").groupBy("did", "h").agg(F.collect_set("text").alias("texts"))
    return alone.select("did", "h", "text").union(one.select("did", "h", F.explode("texts").alias("text")))


def _copies(light: DataFrame, folder: str) -> DataFrame:
    """``did, h, n`` of the texts of LENGTH bytes or more that equal a whole text of a smaller id, by digest and length.

    An id that also has another text is left to the suffix array.
    """
    # stored, so that the join lays this side out itself and can split a text with many copies
    firsts = store.stored(
        light.where(F.col("n") >= LENGTH)
        .groupBy("h", "h2", "n")
        .agg(F.min("did").alias("first"), F.max("did").alias("last"))
        .where("first < last")
        .drop("last"),
        f"{folder}/firsts",
    )
    marked = light.join(firsts, ["h", "h2", "n"], "left").withColumn(
        "copy", F.coalesce(F.col("did") > F.col("first"), F.lit(False))
    )
    by_id = marked.groupBy("did").agg(
        F.min("copy").alias("copy"), F.min("h").alias("h"), F.max("h").alias("other"), F.max("n").alias("n")
    )
    return store.stored(by_id.where("copy AND h = other").select("did", "h", "n"), f"{folder}/copies")


def removed_spans(df: DataFrame, folder: str) -> DataFrame:
    """``did, h, spans`` of the texts that lose bytes, from ``did, h, text``; spans may overlap."""
    light = _light(df, folder)
    copies, df = _copies(light, folder), _once(df, light, folder)
    # by id and text: many texts may share an id, null most of all
    key = F.xxhash64("did", "h").alias("key")
    copied = copies.select(key)
    places = _repeated(_leads(df.select(key.alias("did"), "text"))).withColumnRenamed("did", "key").join(copied, "key", "left_anti")
    records = _records(df.select("did", "h", "text", key).join(places, "key").select("did", "h", "text", "places"))
    by = (F.expr(f"substring(blob, back + 1, {LEAD})"), "did", "h", "at")
    found = store.stored(_found(records.repartitionByRange(*by).sortWithinPartitions(*by)), f"{folder}/found")
    strings = found.where("string is not null")
    earliest = store.stored(
        strings.groupBy("string")
        .agg(F.min(F.struct("did", "h", "start")).alias("earliest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        f"{folder}/earliest",
    )
    across = strings.join(earliest, "string").where(F.struct("did", "h", "start") > F.col("earliest"))
    spans = found.where("string is null").union(across.select(found.columns)).drop("string")
    whole = copies.select("did", "h", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    return spans.union(whole).groupBy("did", "h").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    if not len(starts):
        return starts, stops
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(stops[by])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def remove_repeats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the remaining bytes."""
    spark = df.sparkSession
    store.ship(spark)
    folder = store.scratch(spark, "suffixes")
    rows = df.select(
        F.col(id_col).alias("id"),
        store.row_id(id_col).alias("did"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    spans = removed_spans(rows, folder)
    joined = rows.join(spans, ["did", "h"], "left").select("id", "text", "spans")
    id_type = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 1):
                data, offsets = text.text_bytes(part.column(1))
                lists = part.column(2)
                ends = lists.value_lengths().fill_null(0).to_numpy().cumsum()
                fields = lists.flatten()
                starts, stops = (fields.field(k).to_numpy() for k in (0, 1))
                out: list[tuple] = []
                for k in range(part.num_rows):
                    cut = slice(ends[k - 1] if k else 0, ends[k])
                    own = data[offsets[k] : offsets[k + 1]]
                    first, last = merged(starts[cut], stops[cut])
                    edges = np.concatenate([[0], np.stack([first, last], 1).ravel(), [len(own)]]).astype(np.int64)
                    kept = b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(own), len(own) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds))],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    schema = f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
