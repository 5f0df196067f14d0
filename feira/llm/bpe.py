"""Byte-level BPE: a segment tree over the ranks of adjacent pairs.

A text is cut into pieces by the tokenizer's pattern and each piece starts as
its bytes. The leaves of the tree hold the merge rank of each adjacent pair
with its place, an inner node the least of its children, so the root is the
leftmost merge of the lowest rank. A merge changes three leaves, each at
logarithmic cost; encoding ends when the root has no merge. The trees of new pieces are
worked off side by side as numpy arrays, a long piece alone; what was met lately is kept
in a memory of bounded size, which is emptied at the end of a task if it is large.

The tokenizer comes as the JSON text of a vocabulary file; the driver reads it
and its size does not depend on the data. A null text is an empty text and has no tokens.
Every row gets its own result, repeated and null ids included, and columns
other than id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm import store, tasks, text

#: How byte-level vocabularies of this kind cut a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{other}+|\s+(?!\S)|\s+"""
#: Letters and numbers of Unicode 17, which vocabularies made for Unicode 16 take for other signs.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""

MEMORY = 600_000  # words kept, and a sixth as many pieces of words
WAITING = 50_000  # words that may stay from one task to the next
SLICE = 4 << 20  # bytes of text encoded together
MANY = 4096  # trees side by side
NO_MERGE = 1 << 62


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    def __init__(self, spec: str):
        model = json.loads(spec)
        if model["normalizer"] is not None or model["pre_tokenizer"] != model["pre_tokenizer"] | {
            "type": "ByteLevel", "add_prefix_space": False, "use_regex": True
        }:
            raise ValueError("not a plain byte-level vocabulary")
        as_byte = printable_bytes()
        vocab = model["model"]["vocab"]
        self.pieces = {i: bytes(as_byte[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [0] * 256
        for c, b in as_byte.items():
            self.byte_ids[b] = vocab[c]
        self.ranks: dict[int, int] = {}  # by left id << 32 | right id
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.byte_ranks = [
            self.ranks.get(self.byte_ids[a] << 32 | self.byte_ids[b], -1) for a in range(256) for b in range(256)
        ]
        plain = {"L": r"\p{L}", "N": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}
        newer = "[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in NEWER.split()) + "]"
        exact = {
            "L": rf"[\p{{L}}--{newer}]", "N": rf"[\p{{N}}--{newer}]", "other": rf"[[^\s\p{{L}}\p{{N}}]||{newer}]"
        }
        self._cut = regex.compile(PATTERN.format(**plain)).findall
        self._newer = regex.compile(newer).search
        self._cut_newer = regex.compile(PATTERN.format(**exact), regex.V1).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.byte_ids_array = np.array(self.byte_ids)
        self.byte_ranks_array = np.array(self.byte_ranks)
        self.merged_array = np.array(self.merged)
        order = np.argsort(np.array(list(self.ranks)))
        self.pair_keys = np.array(list(self.ranks))[order]
        self.pair_ranks = np.array(list(self.ranks.values()))[order]
        self.flat = np.frombuffer(b"".join(self.pieces[i] for i in sorted(self.pieces)), np.uint8)
        self.length = np.zeros(max(self.pieces) + 1, np.int32)
        self.length[sorted(self.pieces)] = [len(self.pieces[i]) for i in sorted(self.pieces)]
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.words: dict[str, bytes] = {}  # ids of words after a space
        self.pieces_met: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        ranks, merged, byte_ranks = self.ranks, self.merged, self.byte_ranks
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        bits = size.bit_length()
        mask = (1 << bits) - 1
        tree = [NO_MERGE] * (2 * size)
        for i in range(n - 1):
            rank = byte_ranks[piece[i] << 8 | piece[i + 1]]
            if rank >= 0:
                tree[size + i] = rank << bits | i
        for k in range((size + n - 2) >> 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while tree[1] != NO_MERGE:
            i = tree[1] & mask
            ids[i] = merged[tree[1] >> bits]
            gone = after[i]
            end = after[gone]
            after[i] = end
            ids[gone] = -1
            changes = [(gone, NO_MERGE)]
            if end < n:
                before[end] = i
                rank = ranks.get(ids[i] << 32 | ids[end])
                changes.append((i, NO_MERGE if rank is None else rank << bits | i))
            else:
                changes.append((i, NO_MERGE))
            p = before[i]
            if p >= 0:
                rank = ranks.get(ids[p] << 32 | ids[i])
                changes.append((p, NO_MERGE if rank is None else rank << bits | p))
            for leaf, value in changes:
                k = size + leaf
                if k >= 2 * size or tree[k] == value:  # the last symbol begins no pair
                    continue
                tree[k] = value
                while k > 1:
                    k >>= 1
                    a, b = tree[2 * k], tree[2 * k + 1]
                    least = a if a < b else b
                    if tree[k] == least:
                        break
                    tree[k] = least
        return [i for i in ids if i >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of many pieces: the same trees side by side, one merge of each piece at a time."""
        sizes = np.array([len(p) for p in pieces])
        out: list[list[int]] = [[]] * len(pieces)
        low = 0
        for width in (4, 8, 16, 32, 64):
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(at), MANY):
                some = at[k : k + MANY]
                found = self._side_by_side([pieces[i] for i in some], sizes[some], width)
                for i, ids in zip(some.tolist(), found):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(sizes > low):
            out[i] = self.merge(pieces[i])
        return out

    def _pair_values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at] << bits | place, NO_MERGE)

    def _side_by_side(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[list[int]]:
        m, bits = len(pieces), width.bit_length()
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width).astype(np.int64)
        place = np.arange(width)
        ids = np.where(place < sizes[:, None], self.byte_ids_array[raw], -1)
        tree = np.full((m, 2 * width), NO_MERGE, np.int64)
        ranks = self.byte_ranks_array[raw[:, :-1] << 8 | raw[:, 1:]]
        paired = (ranks >= 0) & (place[1:] < sizes[:, None])
        tree[:, width : 2 * width - 1] = np.where(paired, ranks << bits | place[:-1], NO_MERGE)
        half = width // 2
        while half:
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
            half //= 2
        after = np.broadcast_to(place + 1, (m, width)).copy()
        before = np.broadcast_to(place - 1, (m, width)).copy()
        live = np.flatnonzero(tree[:, 1] != NO_MERGE)
        while len(live):
            root = tree[live, 1]
            i = root & ((1 << bits) - 1)
            new = self.merged_array[root >> bits]
            ids[live, i] = new
            gone = after[live, i]
            end = after[live, gone]
            after[live, i] = end
            ids[live, gone] = -1
            leaves = [(live, gone, np.int64(NO_MERGE))]
            inner = end < sizes[live]
            some, first, last = live[inner], i[inner], end[inner]
            before[some, last] = first
            value = np.full(len(live), NO_MERGE)
            value[inner] = self._pair_values(new[inner], ids[some, last], first, bits)
            leaves.append((live, i, value))
            p = before[live, i]
            inner = p >= 0
            some, first = live[inner], p[inner]
            leaves.append((some, first, self._pair_values(ids[some, first], new[inner], first, bits)))
            for rows, leaf, value in leaves:
                tree[rows, width + leaf] = value
            for rows, leaf, _ in leaves:
                k = width + leaf
                for _ in range(bits - 1):
                    k = k >> 1
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            live = live[tree[live, 1] != NO_MERGE]
        flat = ids[ids >= 0].tolist()
        ends = np.cumsum((ids >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_many(self, bodies: list[str], special: bool = True) -> list[bytes]:
        with _no_cycles():
            return self._encode_many(bodies, special)

    def _encode_many(self, bodies: list[str], special: bool) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        With ``special``, the strings of special tokens are those tokens. Texts are cut at spaces
        first: a piece never runs across a space that a visible character follows. What was not met
        lately is merged side by side.
        """
        parts: list[str] = []
        counts = []
        for body in bodies:
            split = self.split_special.split(body) if special and any(s in body for s in self.special) else [body]
            counts.append(len(split))
            parts.extend(split)
        cut = [part.split(" ") for part in parts]
        whole = []  # texts with white space after a space
        spaced: set[str] = set()
        for words in cut:
            spaced.update(words[1:])
        new = spaced - self.words.keys()
        odd = {w for w in new if not w or w[0].isspace()}
        new -= odd
        pieces = {w: self.cut(" " + w) for w in new}
        for k, (part, words) in enumerate(zip(parts, cut)):
            if len(words) > 1 and odd and not odd.isdisjoint(words[1:]):
                pieces[part] = self.cut(part)
                whole.append(k)
            else:
                pieces["\0" + words[0]] = self.cut(words[0])
        # a piece that begins with a space was met if the word after it is kept and is one piece
        known = self.words.keys()
        wanted = {p for found in pieces.values() for p in found} - self.pieces_met.keys()
        for piece in [p for p in wanted if p[0] == " " and p[1:] in known and len(self.cut(p)) == 1]:
            self.pieces_met[piece] = self.words[piece[1:]]
            wanted.discard(piece)
        unseen = list(wanted)
        for piece, ids in zip(unseen, self.merge_many([p.encode() for p in unseen])):
            self.pieces_met[piece] = struct.pack(f"<{len(ids)}I", *ids)
        met = self.pieces_met.__getitem__
        for w in new:
            self.words[w] = b"".join(map(met, pieces[w]))
        out = []
        fixed = set(whole)
        for k, (part, words) in enumerate(zip(parts, cut)):
            if special and part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif k in fixed:
                out.append(b"".join(map(met, pieces[part])))
            else:
                first = b"".join(map(met, pieces["\0" + words[0]]))
                out.append(first + b"".join(map(self.words.__getitem__, words[1:])))
        self._forget(new, unseen)
        joined, at = [], 0
        for n in counts:
            joined.append(out[at] if n == 1 else b"".join(out[at : at + n]))
            at += n
        return joined

    def encode(self, body: str, special: bool = True) -> bytes:
        return self.encode_many([body], special)[0]

    def cut(self, body: str) -> list[str]:
        """The pieces of a text."""
        return (self._cut if body.isascii() or not self._newer(body) else self._cut_newer)(body)

    def _forget(self, words: set[str], pieces: list[str]) -> None:
        """Keep the memories small: no long strings, and everything goes when there are too many."""
        for memory, most, added in ((self.words, MEMORY, words), (self.pieces_met, MEMORY // 6, pieces)):
            if len(memory) > most:
                memory.clear()
            else:
                for key in added:
                    if len(key) > 64:
                        del memory[key]

    def rest(self) -> None:
        """Empty memories that grew large: the next task may be of another stage."""
        if len(self.words) > WAITING or len(self.pieces_met) > WAITING // 6:
            self.words, self.pieces_met = {}, {}

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.length[tokens]
        ends = np.cumsum(sizes)
        index = np.repeat(self.start[tokens] - (ends - sizes), sizes)
        index += np.arange(len(index))
        return self.flat[index].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(spec: str) -> Bpe:
    """The tokenizer of a vocabulary file's text; a worker builds it once."""
    return Bpe(spec)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the cycle collector: encoding makes many small lists and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def read_spec(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def encode(df: DataFrame, id_col: str, text_col: str, path: str, special: bool = True) -> DataFrame:
    """Per row: id, ``ids`` (array of ints), ``n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of
    the text that decoding these ids gives, in UTF-8.
    """
    spark = df.sparkSession
    store.ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            for part in text.slices(batch, 1, SLICE):
                encoded = bpe.encode_many([t or "" for t in part.column(1).to_pylist()], special)
                decoded = [hashlib.sha256(bpe.decode(e).encode()).hexdigest() for e in encoded]
                sizes = np.array([len(e) // 4 for e in encoded], np.int64)
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(encoded), "<i4")))
                digests = [hashlib.sha256(e).hexdigest() for e in encoded]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(sizes), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                    ["id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        bpe.rest()

    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(tasks.tidy(run), schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str) -> DataFrame:
    """Per row: id and the text of its ids; null ids give an empty text."""
    spark = df.sparkSession
    store.ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(i.as_py() or [], "<u4").tobytes()) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tasks.tidy(run), f"id {id_type}, text string").withColumnRenamed("id", id_col)
