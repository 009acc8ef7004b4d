"""Word lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def vocab_distinct_length(words: DataFrame) -> DataFrame:
    """Number, mean length and its deviation of a person's distinct words in a season."""
    return _lengths(words.select("person", "word", "season").distinct(), "person", "season")


def vocab_episode_length(words: DataFrame) -> DataFrame:
    """The same over all words of a person in an id."""
    return _lengths(words, "person", "id")


def _lengths(words: DataFrame, *keys: str) -> DataFrame:
    length = F.length("word")
    return words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(length).alias("avg_char"),
        F.stddev_samp(length).alias("stdev_char"),
    )


def vocab_normalised(words: DataFrame, pay: DataFrame) -> DataFrame:
    """Characters spoken per person and season, and the same per episode of the season."""
    spoken = words.groupBy("person", "season").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("total_nchar")
    )
    episodes = pay.select("season", F.col("n_groups").alias("num_eps"))
    joined = spoken.join(episodes, "season", "left")
    return joined.withColumn("total_nchar_norm", F.try_divide("total_nchar", "num_eps"))
