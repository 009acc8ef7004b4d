"""From raw documents to token files: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of their docs, whatever their names; columns
doc_id, text and source must be there. Rows with a null or empty text pass the filters and become
documents of just the end id where the mix takes them, which is never, for they have no words.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptweave.llm import decontamination, mixing, setsketch, tokenfiles, toxicity
from scriptweave.llm.labelled import held_out
from scriptweave.operators.durable import durable, new_path

TOKENIZER = "word_bpe_49k.json"
MAX_TOXICITY = 0.5
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The docs under names that no operator uses, and which name each column has now."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``MAX_TOXICITY`` stay; learned from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    lexicon = toxicity.learn(docs, labels)
    rows, names = _numbered(docs)
    rows = toxicity.scored(rows, lexicon, text=names["text"]).filter(F.col("score") < MAX_TOXICITY)
    return rows.drop("score").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; different texts that share an id
    are documents of their own, and of rows equal in id and text one stays.

    Rows with a null id are not compared and stay.
    """
    rows, names = _numbered(docs)
    key, text = names["doc_id"], names["text"]
    known = rows.filter(F.col(key).isNotNull())
    gone = durable(setsketch.first_rows(known, NEAR_WORDS, NEAR_PERCENT, key, text), "gone")
    known = known.withColumn("row", setsketch.row_id(key, text))
    kept = known.join(gone, "row", "left_anti").dropDuplicates(["row"]).drop("row")
    return kept.unionByName(rows.filter(F.col(key).isNull())).select(*rows.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay."""
    rows, names = _numbered(docs)
    found = decontamination.benchmark_hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=names["text"])
    return found.filter("n_hit = 0").select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files; what the files hold of each document."""
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return tokenfiles.summaries(tokenfiles.read_tokens(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_files", token_files),
]

# Learned scores, near copies and tokens are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
