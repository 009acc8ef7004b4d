"""Counts, means and totals over lines and words.

Aggregates are partial before the shuffle, so a hot key moves one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import constants as K
from .durable import durable
from .quantiles import exact_quantile
from .words import by_main, without_stop_words


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_total(counts: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the grand total, a scalar subquery over the counts: however many rows they have,
    no task gathers them, and Spark reuses the exchange both share."""
    return counts.withColumn(name, counts.agg(F.sum(value)).scalar())


# -- quality checks on lines -------------------------------------------------------------


def scenes_per_episode(lines: DataFrame) -> DataFrame:
    """Highest scene number per id. It equals the number of scene markers, so the running
    number is not needed and nothing is sorted."""
    return lines.groupBy("id").agg(F.count(F.when(F.col("type") == "scene", 1)).alias("max_scene"))


def avg_scenes(lines: DataFrame) -> DataFrame:
    return scenes_per_episode(lines).agg(F.avg("max_scene").alias("avg_scenes"))


def total_scenes(lines: DataFrame) -> DataFrame:
    return scenes_per_episode(lines).agg(F.sum("max_scene").alias("num_scenes"))


def lines_per_episode(lines: DataFrame) -> DataFrame:
    return count_by(lines.filter(F.col("type").isin("person", "scene")), "id")


def untyped_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("type").isNull())


def episode_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.countDistinct("id").alias("n"))


def two_part_ids(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("id").contains("-")).select("season", "id").distinct()


def alias_ids(lines: DataFrame, alias: str, id_pattern: str = "^[02]{2}") -> DataFrame:
    """Ids where an alias is still a speaker."""
    left = lines.filter((F.col("type") == "person") & (F.col("person") == alias))
    return left.filter(F.col("id").rlike(id_pattern)).select("id").distinct()


def token_line_recon(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Lines per person and id, as counted on lines and as found again in the words.

    ``words`` carries ``line_no``; a line number per id and person is as good a key as the
    running number made from it.
    """
    spoken = lines.groupBy("person", "id").agg(F.count(F.lit(1)).alias("n_lines"))
    found = words.groupBy("person", "id").agg(F.countDistinct("line_no").alias("n_token_lines"))
    return spoken.join(found, ["person", "id"], "full")


# -- lines -------------------------------------------------------------------------------


def lines_by_person(lines: DataFrame, main: list[str]) -> DataFrame:
    counts = count_by(by_main(lines, main), "person")
    return counts.withColumn("label", F.format_number("n", 0))


def lines_by_person_season(lines: DataFrame, main: list[str]) -> DataFrame:
    """The window sees one row per season and person."""
    counts = count_by(by_main(lines, main), "person", "season")
    return counts.withColumn("avg_lines", F.avg("n").over(W.partitionBy("person")))


def lines_by_person_episode(lines: DataFrame, main: list[str]) -> DataFrame:
    return count_by(by_main(lines, main), "person", "id")


def spoken_by_person_episode(lines: DataFrame, main: list[str]) -> DataFrame:
    spoken = by_main(lines, main).filter(F.col("type") == "person")
    return count_by(spoken, "person", "id", "season")


def lines_per_scene(lines: DataFrame, main: list[str]) -> DataFrame:
    """Per id: scenes with a main speaker, and main speakers' lines per such scene."""
    scenes = count_by(by_main(lines, main), "id", "scene")
    return scenes.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_scenes"), F.avg("n").alias("avg_lines")
    )


def avg_lines_per_episode(lines: DataFrame, main: list[str]) -> DataFrame:
    counts = count_by(by_main(lines, main), "id", "person")
    return counts.groupBy("person").agg(F.avg("n").alias("avg_lines"))


def line_totals(lines: DataFrame, main: list[str]) -> DataFrame:
    counts = by_main(lines, main).groupBy("person").agg(F.count(F.lit(1)).alias("line_total_person"))
    return with_total(counts, "line_total_person", "line_total")


# -- all speakers ------------------------------------------------------------------------


def speaker_totals(lines: DataFrame) -> DataFrame:
    """Lines per speaker, main or not, and all lines spoken. Speakers can be many, so the
    total is a scalar subquery and no window over one partition. The counts are kept on
    storage: the total and the reports below use them several times."""
    spoken = lines.filter(F.col("type") == "person")
    counts = durable(spoken.groupBy("person").agg(F.count(F.lit(1)).alias("total_lines_person")))
    return counts.withColumn("total_lines", counts.agg(F.sum("total_lines_person")).scalar())


def top_speakers(totals: DataFrame, k: int = K.TOP_SPEAKERS) -> DataFrame:
    """The k speakers with most lines, ties kept, sorted.

    The k-th largest total comes from a top-k that keeps k rows per task; everyone at or
    above it is in, which is what rank <= k says.
    """
    n = F.col("total_lines_person")
    cut = totals.select(n).orderBy(F.desc("total_lines_person")).limit(k)
    top = totals.filter(n >= cut.agg(F.min("total_lines_person")).scalar())
    return top.orderBy(F.desc("total_lines_person"), "person")


def main_vs_recurring(totals: DataFrame, main: list[str], quantile: float = K.SPEAKER_QUANTILE) -> DataFrame:
    """Lines of main and other speakers among those above the quantile of speaker totals.

    The quantile is exact, found in rounds of bucket counts over (total, number of speakers) pairs.
    """
    n = F.col("total_lines_person")
    sizes = durable(totals.groupBy(n).agg(F.count(F.lit(1)).alias("speakers")), "sizes")
    cut = exact_quantile(sizes, "total_lines_person", quantile, "speakers")
    kind = F.when(F.col("person").isin(main), "main").otherwise("recurr")
    return (
        totals.filter(n > F.lit(cut))
        .groupBy(kind.alias("is_main"))
        .agg(F.sum("total_lines_person").alias("line_total_group"))
    )


def with_season_number(df: DataFrame, season: str = "season") -> DataFrame:
    """The season as a whole number; one that is none, as of a page without digits in its name, is missing."""
    return df.withColumn(season, F.col(season).try_cast("int"))


# -- words -------------------------------------------------------------------------------


def word_totals(words: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Each person's distinct words that are no stop words, with all words and the person's.

    Counts per person and word come first, kept on storage: the totals, one row per main
    speaker, are sums of counts, and the text is read once.
    """
    counts = durable(count_by(words, "person", "word").transform(without_stop_words, stop_words))
    persons = counts.groupBy("person").agg(F.sum("n").alias("person_words"))
    with_person = counts.join(persons, "person")
    return with_person.withColumn("total_words", counts.agg(F.sum("n")).scalar()).drop("n")


def words_season_mean(words: DataFrame) -> DataFrame:
    counts = count_by(words, "person", "season")
    return counts.withColumn("avg_words", F.avg("n").over(W.partitionBy("season")))


def words_grouping_sets(words: DataFrame) -> DataFrame:
    """Words per person and season, per person, and per season, from one pass over words.

    The sets expand the counts per person and season, not the words.
    """
    counts = count_by(words, "person", "season")
    sets = [[F.col("person"), F.col("season")], [F.col("person")], [F.col("season")]]
    return counts.groupingSets(sets, "person", "season").agg(
        F.grouping_id().cast("long").alias("level"), F.sum("n").alias("n")
    )
