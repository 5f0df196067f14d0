"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from feira.llm import (
    bpe,
    classifier,
    decontaminate,
    fim,
    line_dedup,
    minhash,
    mixing,
    oracle,
    quality,
    sharding,
    store,
    suffix_dedup,
    token_scan,
    trie,
    warc,
)

VOCABULARY = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(VOCABULARY))
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.drop("kept")


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = classifier.train(documents, "doc_id", "text", labels, "doc_id", "quality", ~held_out("doc_id"))
    scored = classifier.score(documents, "doc_id", "text", weights)
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(
        _table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(VOCABULARY), "<|endoftext|>"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.scratch(spark, "warc")
    archives = warc.write_archives(
        _table(spark, sf_dir, "pages"), "page_id", "url", "html", folder, "2024-01-01T00:00:00Z"
    )
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The query's links: three words, 85 percent.
NEAR = minhash.Similarity(words=3, percent=85, bands=24, rows=6)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.annotate(_table(spark, sf_dir, "documents"), "doc_id", "text", NEAR)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(
        "page_id",
        line_dedup.host_of(F.col("url")).alias("host"),
        line_dedup.page_text(F.col("html")).alias("kept_text"),
    )
    lines = F.size(F.split("kept_text", "\n", -1)).cast("long")
    before = pages.withColumn("n_lines", lines)
    return line_dedup.drop_boilerplate(before, "kept_text", F.col("host")).select(
        "page_id", "host", "n_lines", "kept_text"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.annotate(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard_records(_table(spark, sf_dir, "documents"), "doc_id", "text", 8)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("place").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.annotate(
        _table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text"
    )
    return got.drop("matches")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_nodes(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return nodes.drop("ref_conv", "ref_turn")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken")
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.transform(_table(spark, sf_dir, "documents"), "doc_id", "text"), "output", "form")
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        *(F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_token_counts": op4_token_counts,
        "op5_warc": op5_warc,
        "op6_near_dedup": op6_near_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_sharding": op9_sharding,
        "op10_decontamination": op10_decontamination,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_source_mix": op12_source_mix,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
