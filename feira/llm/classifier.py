"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL.

Tokens are runs of word bytes (letters, digits, non-ASCII) and runs of signs. Features are
hashed one- and two-token n-grams, and three-token n-grams of token shapes (case, digits, a repeated token,
the signs themselves). A feature's value is its share of the text's n-grams, so a
score is the sparse dot product of these shares with the weights.

Training reads a bounded sample: the ``sample_rows`` labelled rows whose id hashes lowest, at
most ``FEATURES`` features each. Only the counted features of those rows travel, and one task
streams them through follow-the-regularised-leader updates, ``epochs`` times;
it keeps the sums per feature and nothing else. The weights have a fixed
size. Every row is then scored where it is read.

A null or empty text has no n-grams and gets the score of the bias. Null labels are not learnt from; without any
labelled row every score is 0.5. Rows that repeat are each scored; a
repeated label is learnt from each time. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm import store, text

BITS = 18
FEATURES = 1 << BITS


@dataclass(frozen=True)
class Training:
    sample_rows: int = 20_000  # the bound of the sample
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-6
    scale: float = 10.0  # of the shares, so that a common n-gram counts about as much as the bias


_WORD = text.byte_table("[0-9A-Za-z\\x80-\\xFF]")
_SPACE = text.byte_table("[\\x00-\\x20\\x7F]")
_CLASS = np.where(_SPACE, 0, np.where(_WORD, 1, 2)).astype(np.int8)


def _flag(spec: str) -> np.ndarray:
    return text.byte_table(spec)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token, and the token offsets of the texts."""
    if not len(data):
        empty = np.empty(0, np.uint64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    bounds = np.flatnonzero(change)
    ends = np.append(bounds[1:], len(data))
    real = kind[bounds] > 0
    starts, ends = bounds[real], ends[real]
    at = np.searchsorted(starts, offsets)
    hashes = text.Rolling(data).ranges(starts, ends)

    def some(spec: str) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_flag(spec)[data], out=sums[1:])
        return sums[ends] > sums[starts]

    lower, upper, digit = some("[a-z]"), some("[A-Z]"), some("[0-9]")
    shape = 1 + lower + 2 * upper + 4 * digit + 8 * np.minimum(ends - starts, 15)
    shape = text.mix(shape.astype(np.uint64))
    sign = kind[starts] == 2
    shape[sign] = hashes[sign]
    if len(starts) > 1:
        again = np.zeros(len(starts), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        first = at[:-1][at[:-1] < len(starts)]
        again[first] = False
        shape[again] = np.uint64(0x5EED)
    return hashes, shape, at


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every n-gram occurrence."""
    hashes, shape, at = tokens(data, offsets)
    whose = text.owner(at)
    texts, features = [whose], [hashes]
    for size, source, salt in ((2, hashes, 0xB1), (3, shape, 0x5A)):
        whole = np.flatnonzero(text.fits(at, size))
        grams = text.shingles(source, size)
        texts.append(whose[whole])
        features.append(text.mix(grams[whole] ^ np.uint64(salt)))
    feature = np.concatenate(features) & np.uint64(FEATURES - 1)
    return np.concatenate(texts), feature.astype(np.int64)


def _shares(df: DataFrame) -> DataFrame:
    """``part, label, features, shares`` per row of ``hash, label, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text.slices(batch, 2):
                data, offsets = text.text_bytes(piece.column(2))
                whose, feature = ngrams(data, offsets)
                key, count = np.unique(whose * FEATURES + feature, return_counts=True)
                owner = key // FEATURES
                ends = np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32)
                total = np.maximum(np.bincount(whose, minlength=piece.num_rows), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        piece.column(1),
                        pa.ListArray.from_arrays(ends, pa.array((key % FEATURES).astype(np.int32))),
                        pa.ListArray.from_arrays(ends, pa.array((count / total[owner]).astype(np.float32))),
                    ],
                    ["hash", "label", "features", "shares"],
                )

    return df.mapInArrow(run, "hash long, label int, features array<int>, shares array<float>")


class Ftrl:
    """Follow-the-regularised-leader, proximal form, one weight per feature and a bias."""

    def __init__(self, training: Training, state: bytes | None = None):
        self.p = training
        held = np.zeros((2, FEATURES + 1)) if state is None else np.frombuffer(state, "<f8").reshape(2, -1).copy()
        self.z, self.n = held

    def state(self) -> bytes:
        return np.stack([self.z, self.n]).astype("<f8").tobytes()

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        held = np.abs(z) <= self.p.l1
        w = -(z - np.sign(z) * self.p.l1) / ((self.p.beta + np.sqrt(n)) / self.p.alpha + self.p.l2)
        return np.where(held, 0.0, w)

    def learn(self, features: np.ndarray, shares: np.ndarray, label: int) -> None:
        at = np.append(features, FEATURES)
        x = np.append(shares * self.p.scale, 1.0)
        w = self.weights(at)
        g = (_sigmoid(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.p.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(
    df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, learnable: Column,
    training: Training = Training(),
) -> np.ndarray:
    """The weights learnt from the labelled rows for which ``learnable``, an expression on the label's id, holds."""
    spark = df.sparkSession
    store.ship(spark)
    hashed = F.xxhash64(label_id)
    sample = (
        labels.where(learnable & F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
        .select(F.col(label_id).alias("label_id"), F.col(label_col).cast("int").alias("label"), hashed.alias("hash"))
        .orderBy("hash", "label_id", "label")
        .limit(training.sample_rows)
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    learnt = rows.join(F.broadcast(sample), F.col("id") == F.col("label_id"))  # at most sample_rows rows
    folder = store.scratch(spark, "classifier")
    shares = store.stored(_shares(learnt.select("hash", "label", "text")), f"{folder}/shares")

    state = Ftrl(training).state()
    for epoch in range(1, training.epochs + 1):
        state = _learnt(shares, training, epoch, state)
    return Ftrl(training, state).weights(slice(None)).astype("<f8")


def _learnt(shares: DataFrame, training: Training, epoch: int, state: bytes) -> bytes:
    """The model after one more epoch: one task reads the sample once, sorted by a hash of epoch and row, and holds a batch of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(training, state)
        for batch in batches:
            for row in zip(*(batch.column(k) for k in (1, 2, 3))):
                label, features, share = row
                model.learn(features.values.to_numpy(), share.values.to_numpy().astype(float), label.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([model.state()], pa.binary())], ["state"])

    place = F.xxhash64(F.lit(epoch), "hash").alias("place")
    one = shares.select(place, "label", "features", "shares").coalesce(1).sortWithinPartitions("place", "label")
    return one.mapInArrow(run, "state binary").collect()[0][0]  # a row, two numbers for each feature


def score(df: DataFrame, id_col: str, text_col: str, weights: np.ndarray, training: Training = Training()) -> DataFrame:
    """Per row: id and ``score``, the estimated chance of label 1."""
    spark = df.sparkSession
    store.ship(spark)
    shared = spark.sparkContext.broadcast(weights)
    scale = training.scale
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for piece in text.slices(batch, 1):
                data, offsets = text.text_bytes(piece.column(1))
                whose, feature = ngrams(data, offsets)
                n = piece.num_rows
                total = np.maximum(np.bincount(whose, minlength=n), 1)
                dot = np.bincount(whose, weights=w[feature], minlength=n) * scale / total
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(_sigmoid(dot + w[FEATURES]))], ["id", "score"]
                )

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
