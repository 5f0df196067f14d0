"""Fill-in-the-middle by in-place block rotation, and back.

A text is cut into units, each a word with the whitespace before it, or whitespace that ends the text.
Two cuts drawn from a hash of the id part it into prefix, middle and suffix. The text's bytes are put into one
bytearray, the sentinels are inserted in front of the blocks, and the last block is brought forward by
a rotation: reversing two neighbouring blocks, then both together, exchanges them in place. Restoring looks for the
sentinels, rotates the blocks back and deletes the sentinels, from nothing but the output and its form.

Forms: ``plain``, the text as it is; ``psm``, prefix, suffix, middle; ``spm``, suffix, prefix, middle. A text that is empty,
null (which counts as empty) or holds a sentinel is plain, so that every output can be restored. A sentinel begins with ``<`` and
ends with ``>`` and has neither inside, so none can arise where blocks meet. Draws depend on seed and id alone: rows that repeat
an id draw the same numbers, and a null id counts as no digits. One text is the unit of work: a task holds one and its
rotation, however long. Only the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from feira.llm import store, text

WORD = "[^\\x20\\x09-\\x0D]"
#: fixed values: what stands before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_WORD = text.byte_table(WORD)


@dataclass(frozen=True)
class Fim:
    """Percentages of texts that are transformed, and of these that get the form ``spm``."""

    seed: int = 42
    fim_percent: int = 50
    spm_percent: int = 80


def rotate(data: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks ``start:middle`` and ``middle:end`` in place, by three reversals."""
    for a, b in ((start, middle), (middle, end), (start, end)):
        half = (b - a) // 2
        front = data[a : a + half].copy()
        data[a : a + half] = data[b - half : b][::-1]
        data[b - half : b] = front[::-1]


def exchange(buffer: bytearray, start: int, middle: int, end: int) -> None:
    rotate(np.frombuffer(buffer, np.uint8), start, middle, end)


def transform_text(body: bytes, first: int, second: int, form: str) -> bytes:
    """The output for a text cut before bytes ``first`` and ``second``."""
    if form == "plain":
        return body
    out = bytearray(body)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    # prefix, middle and suffix, each behind its sentinel
    suffix = second + len(PREFIX) + len(MIDDLE)
    exchange(out, first + len(PREFIX) if form == "psm" else 0, suffix, len(out))
    return bytes(out)


def restore_text(output: bytes, form: str) -> bytes:
    """The text that :func:`transform_text` made ``output`` from."""
    if form == "plain":
        return output
    out = bytearray(output)
    moved = out.index(SUFFIX)
    after = out.index(MIDDLE if form == "psm" else PREFIX)
    exchange(out, moved, after, len(out))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = out.rindex(sentinel)
        del out[at : at + len(sentinel)]
    return bytes(out)


def draws(doc_id, seed: int) -> list[int]:
    """Four numbers below 2**32 for an id."""
    digits = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{digits}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero(text.code_points(data)))


def transform(df: DataFrame, id_col: str, text_col: str, how: Fim = Fim()) -> DataFrame:
    """Per row: its id, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and ``output``."""
    store.ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, 1):
                data, offsets = text.text_bytes(part.column(1))
                _, ends, at = text.words(data, offsets, _WORD)
                counts, forms, prefixes, middles, outputs = [], [], [], [], []
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    begin, end = int(offsets[k]), int(offsets[k + 1])
                    body = data[begin:end].tobytes()
                    stops = ends[at[k] : at[k + 1]] - begin
                    if len(body) and (not len(stops) or stops[-1] < len(body)):
                        stops = np.append(stops, len(body))  # whitespace that ends the text
                    n = len(stops)
                    one, two, whether, which = draws(doc_id, how.seed)
                    cuts = sorted((one % (n + 1), two % (n + 1)))
                    first, second = (int(stops[c - 1]) if c else 0 for c in cuts)
                    if not body or whether % 100 >= how.fim_percent or any(s in body for s in (PREFIX, SUFFIX, MIDDLE)):
                        form = "plain"
                    else:
                        form = "spm" if which % 100 < how.spm_percent else "psm"
                    counts.append(n)
                    forms.append(form)
                    prefixes.append(None if form == "plain" else _chars(data[begin : begin + first]))
                    middles.append(None if form == "plain" else _chars(data[begin + first : begin + second]))
                    outputs.append(transform_text(body, first, second, form))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(forms, pa.string()),
                        pa.array(prefixes, pa.int64()),
                        pa.array(middles, pa.int64()),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restore(df: DataFrame, output_col: str, form_col: str) -> DataFrame:
    """``df`` with ``restored``, the text rebuilt from output and form; a null output is restored to null."""
    store.ship(df.sparkSession)
    names = [c for c in df.columns if c != "restored"]
    source = df.select(*(F.col(f"`{c}`") for c in names))
    output, form = names.index(output_col), names.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, output):
                bodies = part.column(output).cast(pa.binary()).to_pylist()
                forms = part.column(form).to_pylist()
                texts = [None if b is None else restore_text(b, f) for b, f in zip(bodies, forms)]
                columns = [*part.columns, pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "restored"])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField("restored", StringType())]))
