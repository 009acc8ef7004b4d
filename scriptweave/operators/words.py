"""Lines to words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..functions.segments import MAX_WORDS, PATTERN_LETTERS, Trie, segmenter, word_pattern
from .numbering import bucketed_totals, with_running_totals
from .steps import exploded

# running line numbers by what they count within
NUMBERS = {"total_line": ["person"], "season_line": ["season", "person"], "episode_line": ["id", "person"]}


def by_main(lines: DataFrame, main: list[str]) -> DataFrame:
    return lines.filter(F.col("person").isin(main))


def spoken_by_main(lines: DataFrame, main: list[str]) -> DataFrame:
    """Speech of the main speakers. On the scan, both filters reach the files."""
    return by_main(lines, main).filter(F.col("type") == "person")


def number_lines(lines: DataFrame, order: list[str] = ["line_no"], ranges: int | None = None) -> DataFrame:
    """Running line numbers from 1 per person, per season and person, and per id and person.
    ``order`` tells the lines of an id apart."""
    totals = {n: (group, F.lit(1)) for n, group in NUMBERS.items()}
    return with_running_totals(lines, ["id", *order], totals, ranges)


def numbers_in_buckets(lines: DataFrame) -> DataFrame:
    """Scene and running line numbers, by id and line number, of a table of ``write_bucketed``: the lines stay where
    they lie. Lines without an id or a line number are counted nowhere and have none."""
    marker = F.when(F.col("type") == "scene", 1).otherwise(0)
    totals = {"scene": (["id"], marker)} | {n: (group, F.lit(1)) for n, group in NUMBERS.items()}
    return bucketed_totals(lines.drop(*totals), totals)


def tokenize(lines: DataFrame) -> DataFrame:
    """One row per word, numbered from 1 in its line, apostrophes removed. A narrow step."""
    keep = [c for c in lines.columns if c not in ("line", "title")]
    words = exploded(lines, X.tokens(F.col("line")), "word", "word_no", keep)
    return words.withColumn("word", F.translate("word", "'", ""))


def tokenize_scripts(lines: DataFrame, word_list: DataFrame | None = None, column: str = "word") -> DataFrame:
    """``tokenize`` for texts in scripts without blanks too: there the longest word of the list that begins
    at a letter is one, else a Katakana run, else the letter with its marks.

    A list of at most ``PATTERN_LETTERS`` letters becomes a pattern, and all lines stay on the JVM side; with a longer
    one, lines in such scripts go to a trie in Python. The list is sent to all tasks; ``MAX_WORDS`` bounds it, and
    a longer one is refused. Null and empty entries are left out.
    """
    listed: list[str] = []
    if word_list is not None:
        words = word_list.select(column).filter(F.length(column) > 0).distinct()
        listed = [r[0] for r in words.limit(MAX_WORDS + 1).toLocalIterator()]
        if len(listed) > MAX_WORDS:
            raise ValueError(f"a word list of more than {MAX_WORDS} words")
    keep = [c for c in lines.columns if c not in ("line", "title")]
    line = F.col("line")
    # words with a blank can stand in no stretch
    trie = Trie(w for w in listed if " " not in w)
    if sum(map(len, listed)) <= PATTERN_LETTERS:
        found = F.when(X.has_unspaced(line), F.regexp_extract_all(X.stretched(line), F.lit(word_pattern(trie)), F.lit(0)))
    else:
        lines = lines.select("*", segmenter(trie)(F.when(X.has_unspaced(line), X.stretched(line))).alias("_words"))
        found = X.parted(F.col("_words"))
    words = exploded(lines, F.coalesce(found, X.tokens(line)), "word", "word_no", keep)
    return words.withColumn("word", F.translate("word", "'", ""))


def without_stop_words(words: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Words not on the stop list. NULL words stay.

    No broadcast is forced: Spark broadcasts a list it knows to be small and otherwise
    shuffles, splitting a hot word by its adaptive skew join.
    """
    return words.join(stop_words.select("word"), "word", "left_anti")


def with_lexicon(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words on the lexicon, once per entry."""
    return words.join(lexicon, "word", "inner")
