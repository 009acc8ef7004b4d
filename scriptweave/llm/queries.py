"""The named queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.durable import new_path
from . import (
    collocations, decontamination, kdshards, licences, linededup, maintext, mixing, quality, ranked, repeats, setsketch, tokenfiles, toxicity,
)
from .labelled import held_out

TOKENIZER = "word_bpe_49k.json"
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels"))
    rows = quality.assessed(documents, model, keep=["doc_id"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op2_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = setsketch.near_documents(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"doc_id": F.col("doc_id"), "text_crc32": F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))}
    rows = kdshards.kd_shards(_table(spark, sf_dir, "documents"), SHARDS, keep=keep)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.benchmark_hits(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return rows.select(
        "doc_id", "n_words", "n_hit", "n_items", decontamination.items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(documents, labels.filter(~held_out(F.col("doc_id"))))
    rows = toxicity.scored(documents, lexicon, keep=["doc_id"])
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extracted(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return tokenfiles.summaries(tokenfiles.read_tokens(spark, path))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_setsketch": op2_setsketch,
    "op3_kd_shards": op3_kd_shards,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_licences": op6_licences,
    "op7_toxicity": op7_toxicity,
    "op8_main_text": op8_main_text,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
    "op11_repeats": op11_repeats,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}

# SQL where it can express a query.
ORACLE: dict[str, str] = {
    "op4_decontamination": decontamination.oracle(),
    "op6_licences": licences.oracle(),
    "op11_repeats": repeats.oracle(),
    "op12_ranked_search": ranked.oracle(),
    "op13_collocations": collocations.oracle(),
}
