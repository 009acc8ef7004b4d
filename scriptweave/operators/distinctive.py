"""Words that set a speaker apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from .durable import durable
from .measures import line_totals
from .numbering import preceding_totals
from .words import without_stop_words


def top_per_group(df: DataFrame, group: str, weight: str, k: int) -> DataFrame:
    """Rows among the k largest weights of their group, ties kept.

    ``rank() <= k`` is a limit that Spark applies in every task before its shuffle, so of a large
    group only k rows a task, and their ties, meet. The input is evaluated once.
    """
    order = W.partitionBy(group).orderBy(F.desc(weight))
    ranked = df.filter(F.col(weight).isNotNull()).withColumn("_rank", F.rank().over(order))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def word_weights(
    words: DataFrame, lines: DataFrame, stop_words: DataFrame, main: list[str]
) -> DataFrame:
    """Weight of each word for each main speaker who said it.

    ``unique``: (times the speaker says it)^2 / (times anyone says it)
    * (all words / the speaker's words), stop words left out.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in words.columns])
    counts = words.groupBy("person", "word").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(complete, 1)).alias("person_word")
    )
    # the only pass over text; everything below reads these counts
    counts = durable(counts.transform(without_stop_words, stop_words))
    # one row per main speaker
    persons = counts.groupBy("person").agg(F.sum("n").alias("person_words"))
    persons = persons.join(line_totals(lines, main), "person", "left")
    said = counts.filter(F.col("person_word") > 0).drop("n")
    # one row per main speaker and word
    anyone = F.sum("person_word").over(W.partitionBy("word"))
    weighted = (
        said.withColumn("anyone_says_word", anyone)
        .join(persons, "person", "left")
        .withColumn("total_words", counts.agg(F.sum("n")).scalar())
    )
    square = F.col("person_word") * F.col("person_word")
    return (
        weighted.withColumn("line_ratio", F.col("line_total") / F.col("line_total_person"))
        .withColumn("word_ratio", F.col("total_words") / F.col("person_words"))
        .withColumn("unique", square / F.col("anyone_says_word") * F.col("word_ratio"))
        .withColumn("unique3", square * F.col("person_word") / F.col("anyone_says_word") * F.col("word_ratio"))
    )


def distinctive_words(
    words: DataFrame,
    lines: DataFrame,
    stop_words: DataFrame,
    main: list[str],
    extra_stop_words: list[str] = K.EXTRA_STOP_WORDS,
    top: int = K.TOP_WORDS,
) -> DataFrame:
    """Each speaker's ``top`` words by weight, of those no one else has a larger weight for."""
    weights = word_weights(words, lines, stop_words, main)
    best = F.max("unique").over(W.partitionBy("word"))
    own = weights.withColumn("_best", best).filter(F.col("unique") == F.col("_best")).drop("_best")
    own = own.filter(~F.col("word").isin(extra_stop_words))
    return top_per_group(own, "person", "unique", top)


def ranked_words(distinctive: DataFrame) -> DataFrame:
    """Display order: by person, times said, then weight (largest first) and word."""
    rows = distinctive.select("person", "word", "person_word", "unique", F.lit(1).alias("_one"))
    order = [F.col("person"), F.col("person_word"), F.desc("unique"), F.col("word")]
    numbered = preceding_totals(rows, order, {"_before": ([], "_one")})
    return numbered.select("person", "word", "person_word", (F.col("_before") + 1).alias("order"))
