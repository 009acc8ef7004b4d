"""Lexicon sentiment over the course of each speaker's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from .numbering import running_totals
from .words import spoken_by_main, tokenize, with_lexicon, without_stop_words

_KEYS = ["id", "season", "person", "line_no"]


def lexicon_hits(
    lines: DataFrame,
    main: list[str],
    stop_words: DataFrame,
    lexicon: DataFrame,
    bucket_lines: int = K.BUCKET_LINES,
    ranges: int | None = None,
) -> DataFrame:
    """Lexicon words of the main speakers with their running line number and bucket.

    Text is tokenised and matched where it is read. What gets shuffled is one narrow marker
    per line, which is numbered, and the matches, which find their line's number by its key.
    """
    spoken = spoken_by_main(lines, main)
    markers = spoken.select("id", "line_no", "person")
    numbered = running_totals(markers, ["id", "line_no"], {"total_line": (["person"], F.lit(1))}, ranges)
    numbered = numbered.select(F.col("id").alias("_id"), F.col("line_no").alias("_line_no"), "total_line")
    words = tokenize(spoken.select(*_KEYS, "line")).drop("word_no")
    hits = words.transform(without_stop_words, stop_words).transform(with_lexicon, lexicon)
    same = [F.col("id").eqNullSafe(F.col("_id")), F.col("line_no").eqNullSafe(F.col("_line_no"))]
    found = hits.join(numbered, same, "left").drop("_id", "_line_no")
    return found.withColumn("bucket", F.expr(f"total_line div {bucket_lines}"))


def score_by_bucket(hits: DataFrame) -> DataFrame:
    return hits.groupBy("person", "bucket").agg(F.sum("score").cast("long").alias("sum_score"))


def polarity_by_bucket(hits: DataFrame) -> DataFrame:
    """Negative and positive counts side by side, their ratio and difference; a side without
    any word is NULL, and so are ratio and difference."""
    wide = hits.groupBy("person", "id", "bucket").pivot("sentiment", ["negative", "positive"]).count()
    return wide.filter("negative is not null or positive is not null").withColumns(
        {
            "ratio": F.try_divide(F.col("positive"), F.col("negative")),
            "diff": F.col("positive") - F.col("negative"),
        }
    )


def emotion_by_bucket(hits: DataFrame) -> DataFrame:
    return hits.groupBy("person", "sentiment", "id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def season_bucket_end(hits: DataFrame) -> DataFrame:
    """Last bucket of each season and person."""
    return hits.groupBy("season", "person").agg(F.max("bucket").alias("bucket"))
