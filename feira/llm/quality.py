"""Quality rules: repetition inside a text, found with a suffix array over its words.

The base rejects texts that are short or made of short phrases that come again. The suffix array judges what
passes it by passages: the share of the words in maximal repeats, and the longest repeat. Its limits
are lower than the base's share, since a passage that is repeated word for word is less likely to be chance.

All texts of a slice share one suffix array: suffixes are ordered by text
first, so neighbours of different texts have no common prefix. Only suffixes
whose first ``min_words`` words (or ``repeat_window``, if fewer) occur twice in their text enter it, since no
other one begins a repeat of that length. The array is built by prefix doubling, and
the ranks of every step are kept to read off the longest common prefix of any two suffixes.
A maximal repeated substring is a common prefix that cannot be extended to the left; the union
of their spans is the repeated part of the text.

Words are runs of bytes other than space and the ASCII controls 9 to 13. A null
text counts as empty, has no words and fails. Every row gets its own result,
repeated or null ids included, and only the id and text columns are read, so
other columns may have any names. One text is the unit of work: memory grows with the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm import store, tasks, text

WORD = "[^\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Texts beyond any of these are rejected."""

    # the base: too short, or made of phrases that come again
    least_words: int = 20
    repeat_window: int = 8  # words; a word in such a window found twice is a repeat word
    most_repeat_percent: int = 30
    # the method: passages, that is sentences and more, that come again word for word
    min_words: int = 20  # shortest repeat that counts as a passage
    most_covered_percent: int = 20  # of the words, by maximal repeats of that length: a fifth of the text
    longest_words: int = 50  # a longer repeat, a paragraph, is judged by its share
    longest_percent: int = 10  # of the words, by one occurrence of the longest repeat


MEASURES = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_repeats", pa.int64()),
    ("n_covered_words", pa.int64()),
    ("longest_repeat", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
]


def _by_text(tokens: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """A value for each run of ``size`` tokens, equal for equal runs of one text only; for runs past the end of the text a value of its own."""
    n = offsets[-1]
    keys = np.arange(n, dtype=np.uint64)  # past the end: nothing is equal
    runs = text.shingles(tokens, size)
    whole = text.fits(offsets, size)
    at = np.flatnonzero(whole)
    salt = text.mix(text.owner(offsets)[at].astype(np.uint64) + np.uint64(1))
    keys = text.mix(keys + np.uint64(1 << 40))
    keys[at] = text.mix(runs[at] ^ salt)
    return keys


class Repeats:
    """The suffix array of the suffixes that begin a repeat of at least ``least`` tokens."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, least: int):
        self.offsets, self.least, n = offsets, least, int(offsets[-1])
        self.levels: list[tuple[int, np.ndarray]] = []
        size = least
        while size > 1:
            size = (size + 1) // 2
            self.levels.insert(0, (size, _by_text(tokens, offsets, size)))
        key = _by_text(tokens, offsets, least)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = np.zeros(n + 1, bool)
        same[1:n] = ordered[1:] == ordered[:-1]
        repeated = same[:-1] | same[1:]
        self.order = order[repeated]
        heads = ~same[:-1][repeated]
        self._level(least, heads, n)
        self._sort(np.append(tokens, np.zeros(least, np.uint64)), n)
        self.lengths = self._lengths(n)

    def _level(self, size: int, heads: np.ndarray, n: int) -> np.ndarray:
        """Ranks at prefixes of ``size``: the place of the first suffix of the group; other suffixes are alone."""
        rank = np.arange(n, 2 * n + 1)
        group = np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))
        rank[self.order] = group
        self.levels.append((size, rank))
        return group

    def _sort(self, tokens: np.ndarray, n: int) -> None:
        """Double the prefix that orders the suffixes until no two share it.

        Runs that occur once have no rank to compare; so the next ``least`` - 1 tokens order first, and
        suffixes with a longer common prefix always stand together.
        """
        end = self.offsets[np.searchsorted(self.offsets, self.order, "right")] if len(self.order) else self.order
        while len(self.order):
            size, rank = self.levels[-1]
            group = rank[self.order]
            at = self.order + size
            ahead = [np.where(at + k < end, tokens[np.minimum(at + k, n)], np.uint64(0)) for k in range(self.least - 1)]
            follow = rank[np.minimum(at, n)]
            by = np.lexsort((follow, *reversed(ahead), group))
            tied = np.zeros(len(by), bool)
            g, f = group[by], follow[by]
            tied[1:] = (g[1:] == g[:-1]) & (f[1:] == f[:-1])
            self.order, end = self.order[by], end[by]
            if not tied.any():
                return
            self._level(2 * size, ~tied, n)

    def _lengths(self, n: int) -> np.ndarray:
        """By token: the longest common prefix with another suffix of the text, 0 if it is shorter than ``least``."""
        lengths = np.zeros(n, np.int64)
        if len(self.order) < 2:
            return lengths
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            live = (a < n) & (b < n)
            equal = np.zeros(len(a), bool)
            equal[live] = rank[a[live]] == rank[b[live]]
            step = equal * size
            a, b, common = a + step, b + step, common + step
        common[common < self.least] = 0
        np.maximum.at(lengths, self.order[:-1], common)
        np.maximum.at(lengths, self.order[1:], common)
        return lengths

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each occurrence of a maximal repeated substring."""
        extended = np.zeros(len(self.lengths), bool)
        extended[1:] = self.lengths[:-1] == self.lengths[1:] + 1
        first = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        extended[first] = False
        starts = np.flatnonzero((self.lengths > 0) & ~extended)
        return starts, self.lengths[starts]

    def inside(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """The tokens in any of the spans."""
        edges = np.zeros(len(self.lengths) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + sizes, -1)
        return np.cumsum(edges[:-1]) > 0


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray, rolling: text.Rolling) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(data == 10)
    nonempty = offsets[:-1] < offsets[1:]
    starts = np.union1d(offsets[:-1][nonempty], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    if len(ends):
        ends = ends - (data[ends - 1] == 10)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[worded], ends[worded]
    whose = np.searchsorted(offsets, starts, "right") - 1
    key = text.mix(rolling.ranges(starts, ends) ^ text.mix(whose.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    n = len(offsets) - 1
    return np.bincount(whose, minlength=n) - np.bincount(whose[first], minlength=n)


_WORD, _SYMBOL = text.byte_table(WORD), text.byte_table(SYMBOL)


def measure(col: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of the texts in an Arrow column."""
    data, offsets = text.text_bytes(col)
    starts, ends, at = text.words(data, offsets, _WORD)
    rolling = text.Rolling(data)
    tokens = rolling.ranges(starts, ends)
    n = len(col)
    out = {
        "n_words": np.diff(at),
        "word_chars": _per_text(_WORD[data] & text.code_points(data), offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": _duplicate_lines(data, offsets, starts, rolling),
    }
    found = Repeats(tokens, at, min(rules.min_words, rules.repeat_window))
    windows = found if found.least == rules.repeat_window else Repeats(tokens, at, rules.repeat_window)
    out["n_repeat_words"] = _per_text(windows.inside(windows.order, rules.repeat_window), at)
    span_starts, sizes = found.spans()
    passages = sizes >= rules.min_words
    span_starts, sizes = span_starts[passages], sizes[passages]
    out["n_covered_words"] = _per_text(found.inside(span_starts, sizes), at)
    whose = np.searchsorted(at, span_starts, "right") - 1
    out["n_repeats"] = np.bincount(whose, minlength=n)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], whose, sizes)
    count, longest = out["n_words"], out["longest_repeat"]
    out["base_failed"] = (count < rules.least_words) | (100 * out["n_repeat_words"] > rules.most_repeat_percent * count)
    repetitive = (100 * out["n_covered_words"] > rules.most_covered_percent * count) | (
        (longest > rules.longest_words) & (100 * longest > rules.longest_percent * count)
    )
    out["kept"] = ~out["base_failed"] & ~repetitive
    return out


def annotate(df: DataFrame, id_col: str, text_col: str, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``df``: its id, the measures, ``base_failed`` and ``kept``."""
    store.ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    names = {pa.int64(): "long", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 1):
                got = measure(part.column(1), rules)
                arrays = [part.column(0), *(pa.array(got[name], kind) for name, kind in MEASURES)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *(name for name, _ in MEASURES)])

    schema = ", ".join([f"id {id_type}", *(f"{name} {names[kind]}" for name, kind in MEASURES)])
    return source.mapInArrow(tasks.tidy(run), schema).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` whose text passes, with all their columns as they are."""
    store.ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, at):
                yield part.filter(pa.array(measure(part.column(at), rules)["kept"]))

    return df.mapInArrow(tasks.tidy(run), df.schema)
