"""From raw documents to token ids: five stages, each over all that the one before kept.

A null text counts as empty wherever it is measured; the quality rules reject empty texts, so later stages see none but those that line
dedup empties, which are kept. Null ids and sources are values like any other; rows that repeat are judged alike, and of those
with words near dedup keeps one. A text of any length is judged as a whole. Extra columns, whatever their names, pass
through all stages but the last unchanged, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm import bpe, decontaminate, line_dedup, minhash, quality, store

#: Near-duplicate documents of the corpus: five words, 80 percent.
NEAR = minhash.Similarity(words=5, percent=80, bands=29, rows=5)
VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality.keep_good(docs, "text")


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, "text", F.col("source"))
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.length("text").cast(kind))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, "doc_id", "text", NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_contaminated(docs, "text", benchmark, "item_id", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    return bpe.encode(docs, "doc_id", "text", public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_site_lines),
    ("near dedup", near_dedup),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL has no byte-pair encoding; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    folder = store.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.stored(docs, f"{folder}/{k}")
    return docs
