"""Named queries over the given tables: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import html as H, text as X
from ..operators import distinctive as D
from ..operators import durable
from ..operators import lines as L
from ..operators import measures as M
from ..operators import pairs
from ..operators import pay as P
from ..operators import sentiment as S
from ..operators import trend as T
from ..operators import vocabulary as V
from ..operators import words as W
from ..operators.numbering import ordinals
from ..sources import dims, lines as lines_io
from ..sources import pages as pages_io
from ..sources.pages import without_files
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TREND_BANDWIDTH = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places: the order of their sums is open."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# -- pages -------------------------------------------------------------------------------


@query
def scan_pages(spark, sf):
    kept = without_files(I.raw_pages(spark, sf), I.EXCLUDED_PAGES)
    return kept.select("page_id", "file", F.length("html").cast("long").alias("n_chars"))


@query
def html_paragraphs(spark, sf):
    return L.html_paragraphs(I.raw_pages(spark, sf).drop("file"), min_paragraphs=0)


@query
def html_crossed(spark, sf):
    """End tags of elements around a paragraph end it."""
    return L.html_paragraphs(I.crossed_pages(spark, sf).drop("file"), min_paragraphs=0, crossed=True)


@query
def page_charsets(spark, sf):
    """Each page decoded by its own declaration."""
    pages = pages_io.with_text(I.encoded_pages(spark, sf))
    return pages.select("page_id", "charset", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def html_br_fallback(spark, sf):
    return L.html_paragraphs(I.raw_pages(spark, sf, broken=True).drop("file"))


@query
def html_title(spark, sf):
    return I.raw_pages(spark, sf).select("page_id", H.title(F.col("html")).alias("title"))


@query
def id_from_name(spark, sf):
    # most page names hold no four digits and stay as they are; a made-up name has them
    pages = I.raw_pages(spark, sf).select("page_id", "file").withColumn("kind", F.col("page_id") % 3)
    number = F.lpad(F.col("page_id").cast("string"), 4, "0")
    name = (
        F.when(F.col("kind") == 0, F.col("file"))
        .when(F.col("kind") == 1, F.concat(F.lit("season/"), number, F.lit(".html")))
        .otherwise(F.concat(F.lit("season/"), number, F.lit("-"), number, F.lit(".html")))
    )
    named = pages.withColumn("name", name).withColumn("id", X.id_from_name(F.col("name")))
    return named.select("page_id", "name", "id", X.season_of(F.col("id")).alias("season"))


@query
def page_lines(spark, sf):
    """Pages to numbered, classified lines, all steps."""
    lines = L.lines_from_pages(I.raw_pages(spark, sf).drop("page_id"))
    return lines.select("source_file", "id", "season", "title", "line_no", "type", "person", "line", "scene")


@query
def page_lines_shared(spark, sf):
    """All kinds of lines, aliases, scenes; ids of two files, and files of one name."""
    lines = I.talk_lines(spark, sf)
    return lines.select("source_file", "id", "season", "title", "line_no", "type", "person", "line", "scene")


@query
def page_lines_added(spark, sf):
    """The lines of page_lines_shared, files of parts "b" added later: the second call gets all files."""
    raw = I.talk_pages(spark, sf).drop("conv_id")
    aliases = dims.literal_table(spark, I.TALK_ALIASES, dims.ALIASES)
    lines, known = L.lines_of_new_pages(raw.filter(~F.col("file").endswith("b.html")), None, aliases, min_paragraphs=3)
    added, _ = L.lines_of_new_pages(raw, known, aliases, min_paragraphs=3)
    lines = lines.unionByName(added)
    return lines.select("source_file", "id", "season", "title", "line_no", "type", "person", "line", "scene")


@query
def page_line_numbers(spark, sf):
    lines = I.talk_lines(spark, sf).select("id", "season", "person", "type", "line_no")
    spoken = W.spoken_by_main(lines, I.TALK_MAIN).drop("type")
    return W.number_lines(spoken).select("id", "season", "person", "line_no", *W.NUMBERS)


@query
def page_token_recon(spark, sf):
    spoken = W.spoken_by_main(I.talk_lines(spark, sf), I.TALK_MAIN)
    return M.token_line_recon(spoken, W.tokenize(spoken))


@query
def untyped_lines(spark, sf):
    return M.untyped_lines(I.talk_lines(spark, sf)).select("id", "line_no", "person", "line")


# -- cleaning and classification ---------------------------------------------------------


@query
def clean_text(spark, sf):
    """Newlines deleted."""
    documents = I.text_table(spark, sf, "documents").select("doc_id", "text")
    return L.clean_text(documents, newline="delete")


@query
def clean_text_space(spark, sf):
    """Newlines to spaces."""
    turns = I.text_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return L.clean_text(turns, newline="space")


@query
def split_paragraphs(spark, sf):
    """Turns of a conversation, few, as one text with blank lines between them, and apart again."""
    turns = I.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n")
    return L.split_paragraphs(turns.select("conv_id", joined.alias("text")))


@query
def classify_lines(spark, sf):
    return I.event_transcript(spark, sf).transform(L.classify_lines).select("id", "line_no", "text", "type")


@query
def split_speaker(spark, sf):
    split = I.event_transcript(spark, sf).transform(L.split_speaker)
    return split.select("id", "line_no", "person", "line")


@query
def split_speaker_keep_rest(spark, sf):
    split = I.event_transcript(spark, sf).transform(L.split_speaker, keep_rest=True)
    return split.select("id", "line_no", "person", "line")


@query
def alias_map(spark, sf):
    return I.event_lines(spark, sf).select("id", "line_no", "person", "line", "type")


@query
def filter_alias_ids(spark, sf):
    return M.alias_ids(I.event_lines(spark, sf, aliases=False), "purc", id_pattern="^[0-2]{2}")


@query
def two_part_ids(spark, sf):
    user = F.col("id").cast("bigint")
    joined = F.concat("id", F.lit("-"), (user + 1).cast("string"))
    lines = I.event_lines(spark, sf).withColumn("id", F.when(user % 10 == 0, joined).otherwise(F.col("id")))
    return M.two_part_ids(lines)


@query
def episode_count(spark, sf):
    return M.episode_count(I.event_lines(spark, sf))


@query
def union_sources(spark, sf):
    stacked = L.union_sources(I.document_lines(spark, sf), I.conversation_lines(spark, sf))
    return stacked.select("id", "season", "person", "line_no", "line", "type")


@query
def lines_roundtrip(spark, sf):
    """Lines written by season, read back with their schema."""
    path = durable.new_path(spark, "lines")
    lines = I.event_scenes(spark, sf).withColumn("source_file", F.lit("events"))
    lines_io.write_lines(lines, path)
    return M.count_by(lines_io.read_lines(spark, path), "season", "type", "person")


@query
def lines_roundtrip_csv(spark, sf):
    path = durable.new_path(spark, "lines-csv")
    lines = I.event_scenes(spark, sf).withColumn("source_file", F.lit("events"))
    lines_io.write_lines(lines, path, format="csv")
    return M.count_by(lines_io.read_lines(spark, path, format="csv"), "season", "type", "person")


@query
def lines_roundtrip_bad(spark, sf):
    """Malformed rows among the good ones: counted, and told from lines without a type."""
    path = durable.new_path(spark, "lines-bad")
    lines = I.event_scenes(spark, sf).withColumn("source_file", F.lit("events"))
    lines_io.write_lines(lines, path, format="csv")
    event = F.col("event_id").cast("string")
    short, wrong = F.concat(event, F.lit(",cut off")), F.concat_ws(",", event, F.lit("t"), F.lit("ten"), *[F.lit(x) for x in "plys1"])
    bad = I.table(spark, sf, "events").filter("event_id % 50 = 0")
    bad = bad.select(F.when(F.col("event_id") % 100 == 0, short).otherwise(wrong).alias("value"))
    lines_io.write_rows(bad, path, "zz")
    good, rejected = lines_io.read_lines_checked(spark, path)
    rejected = rejected.select(F.lit(False).alias("good"), F.lit(None).cast("string").alias("type"))
    return M.count_by(good.select(F.lit(True).alias("good"), "type").unionAll(rejected), "good", "type")


@query
def numbers_from_buckets(spark, sf):
    """Scene and line numbers by id and line number, from a bucketed table."""
    table = lines_io.write_bucketed(I.event_lines(spark, sf), buckets=64)
    return W.numbers_in_buckets(spark.table(table)).select("id", "season", "person", "line_no", "scene", *W.NUMBERS)


# -- scenes and lines --------------------------------------------------------------------


@query
def scene_number(spark, sf):
    return I.event_scenes(spark, sf).select("id", "line_no", "type", "scene")


@query
def scenes_per_episode(spark, sf):
    return M.scenes_per_episode(I.event_lines(spark, sf))


@query
def avg_scenes(spark, sf):
    return rounded(M.avg_scenes(I.event_lines(spark, sf)), "avg_scenes")


@query
def total_scenes(spark, sf):
    return M.total_scenes(I.event_lines(spark, sf))


@query
def lines_per_episode(spark, sf):
    return M.lines_per_episode(I.event_lines(spark, sf))


@query
def lines_by_person(spark, sf):
    return M.lines_by_person(I.event_lines(spark, sf), I.EVENT_MAIN)


@query
def lines_by_person_season(spark, sf):
    return rounded(M.lines_by_person_season(I.event_lines(spark, sf), I.EVENT_MAIN), "avg_lines")


@query
def lines_by_person_episode(spark, sf):
    return M.lines_by_person_episode(I.event_lines(spark, sf), I.EVENT_MAIN)


@query
def spoken_by_person_episode(spark, sf):
    return M.spoken_by_person_episode(I.event_lines(spark, sf), I.EVENT_MAIN)


@query
def lines_per_scene(spark, sf):
    lines = I.event_scenes(spark, sf).select("id", "scene", "person")
    return rounded(M.lines_per_scene(lines, I.EVENT_MAIN), "avg_lines")


@query
def avg_lines_per_episode(spark, sf):
    return rounded(M.avg_lines_per_episode(I.event_lines(spark, sf), I.EVENT_MAIN), "avg_lines")


@query
def line_totals(spark, sf):
    return M.line_totals(I.event_lines(spark, sf), I.EVENT_MAIN)


@query
def speaker_totals(spark, sf):
    return M.speaker_totals(I.event_lines(spark, sf))


@query
def top_speakers(spark, sf):
    return M.top_speakers(M.speaker_totals(I.part_lines(spark, sf)))


@query
def main_vs_recurring(spark, sf):
    return M.main_vs_recurring(M.speaker_totals(I.part_lines(spark, sf)), I.PART_MAIN)


# -- pairs -------------------------------------------------------------------------------


@query
def presence_matrix(spark, sf):
    return pairs.presence_matrix(I.event_scenes(spark, sf), I.EVENT_MAIN)


@query
def cooccurrence(spark, sf):
    return pairs.cooccurrence(I.baskets(spark, sf), I.BRANDS, scene=["id"])


@query
def cooccurrence_scenes(spark, sf):
    return pairs.cooccurrence(I.event_scenes(spark, sf), I.EVENT_MAIN + ["purchase"])


@query
def cooccurrence_all(spark, sf):
    """Parts that share orders, all parts."""
    return pairs.cooccurrence_all(I.order_parts(spark, sf), scene=["id"])


# -- words -------------------------------------------------------------------------------


def _spoken(spark, sf):
    return W.spoken_by_main(I.document_lines(spark, sf), I.DOCUMENT_MAIN)


def _words(spark, sf):
    """Words without running line numbers, which most counts do not need."""
    return W.tokenize(_spoken(spark, sf))


@query
def line_numbers(spark, sf):
    lines = _spoken(spark, sf).drop("line", "type")
    return W.number_lines(lines).select("id", "season", "person", "line_no", *W.NUMBERS)


@query
def tokenize(spark, sf):
    words = W.tokenize(W.number_lines(_spoken(spark, sf)))
    return words.select("id", "season", "person", "line_no", *W.NUMBERS, "word_no", "word")


@query
def tokenize_edge(spark, sf):
    """Apostrophes, dots, hyphens, a line without words and a NULL line, made from events."""
    k = F.get_json_object("props", "$.k")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("don't go, "), k, F.lit(" kettles")))
        .when(F.col("event_type") == "view", F.concat(F.lit("U.S.A. rocks 1,"), k, F.lit("00.5 well-known snake_case")))
        .when(F.col("event_type") == "error", "?!...'")
        .when(F.col("event_type") == "signup", F.concat(F.lit("a.1 "), k, F.lit(".b it’s 'quoted'")))
    )
    lines = I.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), line.alias("line"))
    return W.tokenize(lines).select("line_no", "word_no", "word")


@query
def tokenize_scripts(spark, sf):
    """Words in scripts without blanks, by a word list."""
    words = W.tokenize_scripts(I.script_lines(spark, sf), I.script_words(spark))
    return words.select("id", "line_no", "word_no", "word")


@query
def token_line_recon(spark, sf):
    return M.token_line_recon(_spoken(spark, sf), _words(spark, sf))


@query
def stop_anti_join(spark, sf):
    kept = W.without_stop_words(_words(spark, sf), I.stop_words(spark))
    return kept.select("id", "line_no", "word_no", "word")


def _hits(spark, sf, lexicon):
    lines = I.document_lines(spark, sf)
    return S.lexicon_hits(lines, I.DOCUMENT_MAIN, I.stop_words(spark), I.lexicon(spark, lexicon))


@query
def sent_score(spark, sf):
    return S.score_by_bucket(_hits(spark, sf, "score"))


@query
def sent_score_from_files(spark, sf):
    """The stop list and the lexicon written, and read from storage."""
    stop_path, lexicon_path = durable.new_path(spark, "stop"), durable.new_path(spark, "lexicon")
    I.stop_words(spark).write.parquet(stop_path)
    I.lexicon(spark, "score").write.parquet(lexicon_path)
    stop = dims.read_lexicon(spark, stop_path, dims.STOP_WORDS)
    scores = dims.read_lexicon(spark, lexicon_path, dims.LEX_SCORE)
    return S.score_by_bucket(S.lexicon_hits(I.document_lines(spark, sf), I.DOCUMENT_MAIN, stop, scores))


@query
def season_bucket_end(spark, sf):
    return S.season_bucket_end(_hits(spark, sf, "score"))


@query
def sent_polarity(spark, sf):
    return rounded(S.polarity_by_bucket(_hits(spark, sf, "polarity")), "ratio")


@query
def sent_emotion(spark, sf):
    return S.emotion_by_bucket(_hits(spark, sf, "emotion"))


@query
def trend_smooth(spark, sf):
    series = S.score_by_bucket(_hits(spark, sf, "score"))
    return rounded(T.trend_smooth(series, ["person"], "bucket", "sum_score", TREND_BANDWIDTH), "trend")


@query
def trend_smooth_ratio(spark, sf):
    """Several ids can share a bucket, and a ratio can be missing."""
    series = S.polarity_by_bucket(_hits(spark, sf, "polarity"))
    return rounded(T.trend_smooth(series, ["person"], "bucket", "ratio", TREND_BANDWIDTH), "trend")


@query
def trend_emotion(spark, sf):
    """Per speaker and emotion."""
    series = S.emotion_by_bucket(_hits(spark, sf, "emotion"))
    return rounded(T.trend_smooth(series, ["person", "sentiment"], "bucket", "n", TREND_BANDWIDTH), "trend")


@query
def trend_lines_by_episode(spark, sf):
    """Lines of each main speaker over the ids in order."""
    series = ordinals(M.lines_by_person_episode(I.event_lines(spark, sf), I.EVENT_MAIN), "id", "episode")
    return rounded(T.trend_smooth(series, ["person"], "episode", "n", TREND_BANDWIDTH), "trend")


@query
def trend_lines_by_season(spark, sf):
    """The same over the seasons, as numbers."""
    series = M.with_season_number(M.lines_by_person_season(I.event_lines(spark, sf), I.EVENT_MAIN))
    return rounded(T.trend_smooth(series, ["person"], "season", "n", TREND_BANDWIDTH), "trend")


@query
def trend_season_numbers(spark, sf):
    """Some seasons are no numbers, as of a page whose name holds no digits."""
    lines = I.event_lines(spark, sf)
    lines = lines.withColumn("season", F.when(F.col("id").cast("int") % 7 == 3, "pi").otherwise(F.col("season")))
    series = M.with_season_number(M.lines_by_person_season(lines, I.EVENT_MAIN))
    return rounded(T.trend_smooth(series, ["person"], "season", "n", TREND_BANDWIDTH), "trend")


@query
def trend_span(spark, sf):
    """A span of the nearest points, however sparse the buckets are."""
    series = S.score_by_bucket(_hits(spark, sf, "score"))
    return rounded(T.trend_span(series, ["person"], "bucket", "sum_score"), "trend")


@query
def trend_vocab_season(spark, sf):
    series = ordinals(V.vocab_distinct_length(_words(spark, sf)), "season", "place")
    return rounded(T.trend_smooth(series, ["person"], "place", "avg_char", TREND_BANDWIDTH), "trend")


@query
def trend_vocab_episode(spark, sf):
    series = ordinals(V.vocab_episode_length(_words(spark, sf)), "id", "episode")
    return rounded(T.trend_smooth(series, ["person"], "episode", "avg_char", TREND_BANDWIDTH), "trend")


@query
def trend_nchar(spark, sf):
    series = ordinals(V.vocab_normalised(_words(spark, sf), I.pay(spark)), "season", "place")
    return rounded(T.trend_smooth(series, ["person"], "place", "total_nchar_norm", TREND_BANDWIDTH), "trend")


@query
def word_totals(spark, sf):
    return M.word_totals(_words(spark, sf), I.stop_words(spark))


def _distinctive(spark, sf):
    lines = I.document_lines(spark, sf)
    words = _words(spark, sf)
    return D.distinctive_words(words, lines, I.stop_words(spark), I.DOCUMENT_MAIN, I.EXTRA_STOP_WORDS)


@query
def distinctive_words(spark, sf):
    found = _distinctive(spark, sf).select(
        "person", "word", "person_word", "anyone_says_word", "total_words", "person_words",
        "line_ratio", "word_ratio", "unique", "unique3",
    )
    return rounded(found, "line_ratio", "word_ratio", "unique", "unique3")


@query
def distinctive_words_ranked(spark, sf):
    return D.ranked_words(_distinctive(spark, sf))


@query
def words_by_person_season(spark, sf):
    return M.count_by(_words(spark, sf), "person", "season")


@query
def words_by_person(spark, sf):
    return M.count_by(_words(spark, sf), "person")


@query
def words_by_season(spark, sf):
    return M.count_by(_words(spark, sf), "season")


@query
def words_grouping_sets(spark, sf):
    return M.words_grouping_sets(_words(spark, sf))


@query
def words_season_mean(spark, sf):
    return rounded(M.words_season_mean(_words(spark, sf)), "avg_words")


@query
def vocab_distinct_length(spark, sf):
    return rounded(V.vocab_distinct_length(_words(spark, sf)), "avg_char", "stdev_char")


@query
def vocab_episode_length(spark, sf):
    return rounded(V.vocab_episode_length(_words(spark, sf)), "avg_char", "stdev_char")


@query
def vocab_normalised(spark, sf):
    return rounded(V.vocab_normalised(_words(spark, sf), I.pay(spark)), "total_nchar_norm")


# -- pay ---------------------------------------------------------------------------------


def _pay_table(spark, sf):
    lines = I.document_lines(spark, sf)
    return P.pay_table(lines, _words(spark, sf), I.pay(spark), I.DOCUMENT_MAIN)


@query
def pay_table(spark, sf):
    return rounded(_pay_table(spark, sf), "season_salary", "season_salary_adj", "total_salary", "total_salary_adj")


@query
def salary_totals(spark, sf):
    """Pay of the seasons that occur in the lines."""
    seasons = I.table(spark, sf, "documents").select(F.col("lang").alias("season")).distinct()
    totals = P.salary_totals(I.pay(spark).join(seasons, "season", "left_semi"))
    return rounded(totals, "season_salary", "season_salary_adj", "total_salary", "total_salary_adj")


@query
def pay_per_season(spark, sf):
    pay = P.pay_per_season(_pay_table(spark, sf), I.display_names(spark))
    return rounded(pay, "pay_per_line_per_season", "pay_per_word_per_season")


@query
def pay_overall_long(spark, sf):
    pay = P.pay_overall_long(_pay_table(spark, sf), I.display_names(spark))
    return pay.select(
        "person", "stat", F.round("overall_pay", 6).alias("overall_pay"),
        P.money(F.col("overall_pay"), 0).alias("label"),
    )
