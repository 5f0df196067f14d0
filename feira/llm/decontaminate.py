"""Benchmark decontamination: benchmark suffixes looked up in suffix arrays over the documents.

Documents are cut into shards, whole texts of a few megabytes together. A shard
gets a suffix array over its words, and every benchmark suffix is binary-searched in
it; suffixes of the shard whose first two words begin no benchmark suffix are left out
of the array, since the search could not end at them. A range of the array holds the places of
one benchmark window. Windows that follow each other in document and
item make one longest verbatim match. Documents are neither shuffled nor
split; the benchmark goes to the tasks in blocks of bounded size.

Words are runs of letters a-z, digits and non-ASCII characters after A-Z are
lower-cased, compared by 64-bit hashes. A window is ``window`` words in a row, or a
whole item that has fewer. Null texts have no words; an item without words occurs nowhere; a null
item id is written as an empty string; items that repeat an id count once. Every document row gets its own result,
repeated and null ids included. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm import files, store, tasks, text
from feira.llm.sorting import multikey_order

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
WINDOW = 13
BLOCK_BYTES = 8 << 20
KEPT_BLOCKS = 4  # that a task keeps ready; of a benchmark with more, each is made once for a larger slice of documents
LARGE_SLICE = 16 << 20

_WORD = text.byte_table(WORD)
_WORD[65:91] = True  # A-Z become a-z


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, and the offsets between texts."""
    data, offsets = text.text_bytes(col)
    starts, ends, at = text.words(data, offsets, _WORD)
    return text.Rolling(data, lower=True).ranges(starts, ends), at


class Block:
    """The windows of some items, ready to be searched for."""

    def __init__(self, words: np.ndarray, at: np.ndarray, ids: list[bytes], window: int):
        sizes = np.diff(at)
        item = text.owner(at)
        offset = np.arange(at[-1]) - np.repeat(at[:-1], sizes)
        begins = (offset + window <= sizes[item]) | (offset == 0)
        self.starts = np.flatnonzero(begins)
        self.item, self.offset, self.ids = item[begins], offset[begins], ids
        self.length = np.minimum(sizes[self.item], window)
        padded = np.append(words, np.zeros(window, np.uint64))
        grid = padded[self.starts[:, None] + np.arange(window)]
        past = np.arange(window) >= self.length[:, None]
        grid[past] = 0
        self.low = _strings(grid)
        grid[past] = np.uint64(2**64 - 1)
        self.high = _strings(grid)
        pair = text.shingles(np.append(words, np.uint64(0)), 2)[self.starts]
        self.pairs = np.unique(pair[self.length > 1])
        self.single = np.unique(words[self.starts[self.length == 1]])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def may_begin(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places in a shard whose first words begin some window."""
        n = len(words)
        if not n:
            return np.empty(0, np.int64)
        pair = text.shingles(words, 2)
        inside = np.ones(n - 1, bool)
        inside[at[(at > 0) & (at < n)] - 1] = False  # the last word of a text
        near = np.flatnonzero(self.filter[(pair & np.uint64((1 << 20) - 1)).astype(np.int64)] & inside)
        places = near[np.isin(pair[near], self.pairs)]
        if len(self.single):
            places = np.union1d(places, np.flatnonzero(np.isin(words, self.single)))
        return places


def _strings(grid: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings that compare like the rows."""
    width = 8 * grid.shape[1]
    return np.ascontiguousarray(grid.astype(">u8")).view(f"S{width}").reshape(-1)


def find(words: np.ndarray, at: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, ...]:
    """Longest matches of a shard: place of the first word, item, its word, and length in words."""
    places = block.may_begin(words, at)
    limit = at[np.searchsorted(at, places, "right")] if len(places) else places
    padded = np.append(words, np.zeros(window, np.uint64))

    def key(d: int, items: np.ndarray) -> np.ndarray:
        where = places[items] + d
        return np.where(where < limit[items], padded[where], np.uint64(0))

    order, _ = multikey_order(key, len(places), window)
    array = places[order]
    grid = np.stack([key(d, order) for d in range(window)], 1) if len(order) else np.empty((0, window), np.uint64)
    suffixes = _strings(grid)
    low = np.searchsorted(suffixes, block.low, "left")
    count = np.maximum(np.searchsorted(suffixes, block.high, "right") - low, 0)
    query = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
    place = array[np.repeat(low, count) + within]
    item, offset = block.item[query], block.offset[query]
    by = np.lexsort((place, place - offset, item))
    place, item, offset, length = place[by], item[by], offset[by], block.length[query][by]
    follows = np.zeros(len(place), bool)
    follows[1:] = (item[1:] == item[:-1]) & (place[1:] == place[:-1] + 1) & (offset[1:] == offset[:-1] + 1)
    # windows of one item that meet across two texts do not follow each other
    follows[1:] &= np.searchsorted(at, place[1:], "right") == np.searchsorted(at, place[:-1], "right")
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    return place[first], item[first], offset[first], place[last] + length[last] - place[first]


def write_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[tuple[str, ...]]:
    """Store the items as files of bounded size; returns the files of each block that tasks read one after another.

    Tasks split, hash and write the items. The driver gets one row for each file and puts small files together.
    """
    store.ship(benchmark.sparkSession)
    folder, limit = store.scratch(benchmark.sparkSession, "benchmark"), BLOCK_BYTES
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in text.slices(batch, 1, limit):
                held.append(part)
                size += len(text.text_bytes(part.column(1))[0])
                if size > limit:
                    yield _write(held, size, f"{folder}/files")
                    held, size = [], 0
        if held:
            yield _write(held, size, f"{folder}/files")

    listed = store.stored(rows.mapInArrow(tasks.tidy(run), "uri string, bytes long"), f"{folder}/list")
    blocks: list[tuple[str, ...]] = []
    block: list[str] = []
    held = 0
    for uri, size in listed.toLocalIterator():
        if block and held + size > limit:
            blocks.append(tuple(block))
            block, held = [], 0
        block.append(uri)
        held += size
    return [*blocks, tuple(block)] if block else blocks


def _write(parts: list[pa.RecordBatch], size: int, folder: str) -> pa.RecordBatch:
    """Write items as one file; returns its ``uri, bytes``."""
    table = pa.Table.from_batches(parts).combine_chunks()
    words, at = tokens(table.column(1).chunk(0))
    ids = json.dumps(table.column(0).to_pylist()).encode()
    out = io.BytesIO()
    np.savez(out, words=words, at=at, ids=np.frombuffer(ids, np.uint8))
    f = files.Output(folder, ".npz")
    f.write(out.getvalue())
    f.close()
    return pa.RecordBatch.from_arrays([pa.array([f.uri]), pa.array([size], pa.int64())], ["uri", "bytes"])


@lru_cache(maxsize=KEPT_BLOCKS)
def _block(uris: tuple[str, ...], window: int) -> Block:
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    ids: list[bytes] = []
    for uri in uris:
        with np.load(io.BytesIO(files.read_all(uri))) as z:
            words.append(z["words"])
            sizes.append(np.diff(z["at"]))
            ids += [i.encode() for i in json.loads(z["ids"].tobytes())]
    return Block(np.concatenate(words), np.append(0, np.cumsum(np.concatenate(sizes))), ids, window)


def _shards(batch: pa.RecordBatch, column: int, blocks: list[tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
    """Whole texts that share a suffix array: more of them where the benchmark has more blocks than are kept."""
    return text.slices(batch, column, text.SLICE_BYTES if len(blocks) <= KEPT_BLOCKS else LARGE_SLICE)


def _judge(col: pa.Array, blocks: list[tuple[str, ...]], window: int) -> tuple[dict[str, np.ndarray], list[list[bytes]], list[tuple]]:
    """Words, hit words and items by text, and the matches, over all blocks."""
    words, at = tokens(col)
    hit = np.zeros(len(words) + 1, np.int64)
    items: list[set[bytes]] = [set() for _ in range(len(col))]
    matches = []
    for uris in blocks:
        block = _block(uris, window)
        place, item, offset, length = find(words, at, block, window)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + length, -1)
        whose = np.searchsorted(at, place, "right") - 1
        for d, i, p, o, n in zip(whose.tolist(), item.tolist(), (place - at[whose]).tolist(), offset.tolist(), length.tolist()):
            items[d].add(block.ids[i])
            matches.append((d, block.ids[i], p, o, n))
    covered = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.cumsum(hit[:-1]) > 0, out=covered[1:])
    n_words, n_hit = np.diff(at), covered[at[1:]] - covered[at[:-1]]
    judged = {"n_words": n_words, "n_hit": n_hit, "contaminated": (n_hit > 0) & (20 * n_hit >= n_words)}
    return judged, [sorted(s) for s in items], matches


def annotate(
    df: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int = WINDOW
) -> DataFrame:
    """Per row: id, ``n_words, n_hit, n_items, items_sha256, contaminated, matches``.

    ``matches`` are the longest verbatim matches: item, first word in the
    document and in the item, and length in words.
    """
    store.ship(df.sparkSession)
    blocks = write_blocks(benchmark, item_col, item_text, window)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    match = pa.struct(
        [("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _shards(batch, 1, blocks):
                judged, items, found = _judge(part.column(1), blocks, window)
                per: list[list[dict]] = [[] for _ in items]
                for d, i, p, o, n in found:
                    per[d].append({"item_id": i.decode(), "doc_word": p, "item_word": o, "n_words": n})
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(judged["n_words"], pa.int64()),
                        pa.array(judged["n_hit"], pa.int64()),
                        pa.array([len(i) for i in items], pa.int64()),
                        pa.array([hashlib.sha256(b",".join(i)).hexdigest() for i in items], pa.string()),
                        pa.array(judged["contaminated"], pa.bool_()),
                        pa.array(per, pa.list_(match)),
                    ],
                    ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"],
                )

    id_type = source.schema["id"].dataType.simpleString()
    schema = (
        f"id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "matches array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"
    )
    return source.mapInArrow(tasks.tidy(run), schema).withColumnRenamed("id", id_col)


def remove_contaminated(
    df: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int = WINDOW
) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with all their columns as they are."""
    store.ship(df.sparkSession)
    blocks = write_blocks(benchmark, item_col, item_text, window)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _shards(batch, at, blocks):
                judged, _, _ = _judge(part.column(at), blocks, window)
                yield part.filter(pa.array(~judged["contaminated"]))

    return df.mapInArrow(tasks.tidy(run), df.schema)
