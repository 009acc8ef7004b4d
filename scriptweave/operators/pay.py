"""Pay per line and per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .measures import count_by, with_total
from .words import by_main


def salary_totals(pay: DataFrame) -> DataFrame:
    """Pay of each season and of all, as paid and adjusted."""
    seasons = pay.withColumns(
        {
            "season_salary": F.col("pay") * F.col("n_groups"),
            "season_salary_adj": F.col("pay_adj") * F.col("n_groups"),
        }
    )
    return seasons.withColumns(
        {
            "total_salary": seasons.agg(F.sum("season_salary")).scalar(),
            "total_salary_adj": seasons.agg(F.sum("season_salary_adj")).scalar(),
        }
    )


def _per_season(df: DataFrame, what: str) -> DataFrame:
    """Counts per person and season with the grand total and the person's total; the window sees
    one row per season of a person."""
    counts = count_by(df, "person", "season").withColumnRenamed("n", f"num_{what}")
    counts = with_total(counts, f"num_{what}", f"total_{what}")
    return counts.withColumn(f"total_{what}_person", F.sum(f"num_{what}").over(W.partitionBy("person")))


def pay_table(lines: DataFrame, words: DataFrame, pay: DataFrame, main: list[str]) -> DataFrame:
    """Lines, words and pay per person and season; a season on either side alone stays."""
    return (
        _per_season(by_main(lines, main), "lines")
        .join(_per_season(words, "words"), ["person", "season"], "full")
        .join(salary_totals(pay), "season", "full")
    )


def _displayed(df: DataFrame, display_names: DataFrame) -> DataFrame:
    named = df.join(display_names, "person", "left")
    return named.withColumn("person", F.coalesce("display", "person")).drop("display")


def pay_formulas(table: DataFrame) -> DataFrame:
    return table.withColumns(
        {
            "pay_per_line_per_season": F.try_divide("season_salary_adj", "num_lines"),
            "pay_per_word_per_season": F.try_divide("season_salary_adj", "num_words"),
            "overall_pay_per_line": F.try_divide("total_salary_adj", "total_lines_person"),
            "overall_pay_per_word": F.try_divide("total_salary_adj", "total_words_person"),
        }
    )


def money(x: Column, digits: int) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(x, digits), digits))


def pay_per_season(table: DataFrame, display_names: DataFrame) -> DataFrame:
    rows = pay_formulas(table).select(
        "person", "season", "pay_per_line_per_season", "pay_per_word_per_season"
    )
    return _displayed(rows.distinct(), display_names)


def pay_overall_long(table: DataFrame, display_names: DataFrame) -> DataFrame:
    """Overall pay per line and per word as one row each."""
    overall = table.select("person", "total_lines_person", "total_words_person", "total_salary_adj")
    overall = _displayed(overall.distinct(), display_names).select(
        "person",
        F.try_divide("total_salary_adj", "total_lines_person").alias("USD Per Line"),
        F.try_divide("total_salary_adj", "total_words_person").alias("USD Per Word"),
    )
    return overall.unpivot("person", ["USD Per Line", "USD Per Word"], "stat", "overall_pay")
