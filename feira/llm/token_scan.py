"""Token counts of documents in flat token files that have no index.

A token file is a run of little-endian unsigned integers in which an
end-of-document id closes each document. Files are cut into blocks at fixed
places, whatever documents lie there. Each block is searched for the id with one vectorised
comparison; its number of ends and its last end are then carried to the blocks after it by
a prefix scan over the blocks of a file, so a document that spans blocks gets
its whole length and its number in the file. Blocks are read independently
and a lost task reads its blocks again.

An empty document has 0 tokens. Tokens after the last end count as one more document. An empty
file has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feira.llm import bpe, files, store, tasks, text

FILE_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 19
TASK_BLOCKS = 32


def write_token_files(
    df: DataFrame, id_col: str, text_col: str, path: str, end_token: str, folder: str, width: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Encode texts into token files under ``folder``, ids of ``width`` bytes, each text closed by ``end_token``.

    Returns the files (``uri, bytes``) and where documents went (``uri, number, id``).
    A null text is a document without tokens. The string of a special token in a text is ordinary text. Null ids, repeated
    rows and repeated ids are documents like any other; only the two columns are read. An empty table has no files. An id
    that does not fit the width is an error before anything is written.
    """
    spark = df.sparkSession
    store.ship(spark)
    vocabulary = bpe.read_spec(path)
    if max(bpe.tokenizer(vocabulary).pieces) >= 1 << (8 * width):
        raise ValueError(f"ids of {path} do not fit in {width} bytes")
    spec = spark.sparkContext.broadcast(vocabulary)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(spec.value)
        end = np.array([tokenizer.special[end_token]], f"<u{width}").tobytes()
        out, held = None, []

        def close() -> pa.RecordBatch:
            out.close()
            ids = pa.concat_arrays(held)
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([out.uri] * n, pa.string()),
                    pa.array(np.full(n, out.size)),
                    pa.array(np.arange(n)),
                    ids,
                ],
                ["uri", "bytes", "number", "id"],
            )

        for batch in batches:
            for part in text.slices(batch, 1, bpe.SLICE):
                if out is None:
                    out = files.Output(folder, ".bin")
                for ids in tokenizer.encode_many([t or "" for t in part.column(1).to_pylist()], special=False):
                    out.write(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end)
                held.append(part.column(0))
                if out.size >= FILE_BYTES:
                    yield close()
                    out, held = None, []
        if out is not None:
            yield close()
        tokenizer.rest()

    written = store.stored(
        source.mapInArrow(tasks.tidy(run), f"uri string, bytes long, number long, id {id_kind}"), f"{folder}/written"
    )
    return written.select("uri", "bytes").distinct(), written.select("uri", "number", "id")


def scan_blocks(token_files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """``uri, block, n, last, ends``: the ends found in each block, as token positions in the file."""
    store.ship(token_files.sparkSession)
    tokens = F.floor(F.col("bytes") / width)
    blocks = token_files.where(tokens > 0).select(
        "uri", tokens.alias("tokens"), F.explode(F.sequence(F.lit(0), F.floor((tokens - 1) / block))).alias("block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block"] * block
                size = min(block, row["tokens"] - start)
                ids = np.frombuffer(files.read_range(row["uri"], start * width, size * width), f"<u{width}")
                ends = start + np.flatnonzero(ids == end_id)
                if start + size == row["tokens"] and (not len(ends) or ends[-1] != row["tokens"] - 1):
                    ends = np.append(ends, row["tokens"])  # an unclosed document
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "uri": row["uri"],
                            "block": row["block"],
                            "n": len(ends),
                            "last": int(ends[-1]) if len(ends) else None,
                            "ends": ends.tolist(),
                        }
                    ],
                    pa.schema(
                        [("uri", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64()))]
                    ),
                )

    # a task for a few blocks; their names alone are too few bytes for Spark to spread
    return blocks.repartition(blocks.count() // TASK_BLOCKS + 1).mapInArrow(
        run, "uri string, block long, n long, last long, ends array<long>"
    )


def token_counts(token_files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """``uri, number, n_tokens`` for each document of the files (``uri, bytes``)."""
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scan_blocks(token_files, end_id, width, block).select(
        "uri",
        "ends",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
    )
    ends = carried.select(
        "uri", "first", F.concat(F.array("carry"), "ends").alias("edges"), F.posexplode("ends").alias("k", "end")
    )
    return ends.select(
        "uri", (F.col("first") + F.col("k")).alias("number"), (F.col("end") - F.col("edges")[F.col("k")] - 1).alias("n_tokens")
    )


def document_token_counts(
    df: DataFrame, id_col: str, text_col: str, path: str, end_token: str, width: int = 2
) -> DataFrame:
    """Per row of ``df``: id and ``n_tokens``, by way of token files."""
    folder = store.scratch(df.sparkSession, "tokens")
    token_files, places = write_token_files(df, id_col, text_col, path, end_token, folder, width)
    end_id = bpe.Bpe(bpe.read_spec(path)).special[end_token]
    # merged: what leaves a window is much larger than the blocks that enter it, by which Spark would choose
    counts = token_counts(token_files, end_id, width).hint("merge")
    return places.join(counts, ["uri", "number"]).select(F.col("id").alias(id_col), "n_tokens")
