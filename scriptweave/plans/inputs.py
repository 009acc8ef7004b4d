"""Transcripts made from the given tables, and small tables to go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import lines as L
from ..operators.steps import exploded
from ..sources import dims

# The main speakers of each input.
EVENT_MAIN = ["click", "view"]
DOCUMENT_MAIN = [f"src{i}" for i in range(6)]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]

# Pages left out by name.
EXCLUDED_PAGES = ["https://thther.example.org/en/685", "http://therha.example.com/en/676"]

ALIASES = [("purc", "purchase"), ("view", "view"), ("sgnp", "signup")]
DISPLAY_NAMES = [(f"src{i}", f"source {i} (src{i})") for i in range(5)]

# Invented lexicons over frequent tokens of the documents. The stop list has a repeated word
# and one that never occurs; one scored word is also a stop word.
STOP_WORDS = [(w,) for w in "the of de and to in a der en it for was on with que le the qqqq".split()]
LEX_SCORE = [
    ("la", 2), ("is", 1), ("that", -1), ("die", 3), ("be", -2), ("des", 1), ("und", -1), ("er", 4),
    ("this", -3), ("re", 2), ("ha", -5), ("un", 5), ("los", -4), ("to", 5), ("zzzz", 1),
]
LEX_POLARITY = [
    ("la", "positive"), ("is", "positive"), ("is", "negative"), ("die", "negative"), ("be", "negative"),
    ("des", "positive"), ("er", "positive"), ("re", "negative"), ("un", "negative"), ("zzzz", "positive"),
]
LEX_EMOTION = [
    ("la", "joy"), ("la", "trust"), ("is", "anger"), ("die", "fear"), ("be", "joy"), ("des", "sadness"),
    ("er", "trust"), ("un", "anger"), ("un", "fear"), ("zzzz", "surprise"),
]
EXTRA_STOP_WORDS = ["ed", "nt", "ly", "ing"]
PAY = [
    ("en", 1200.0, 1350.5, 4.0),
    ("fr", 2000.0, 2400.25, 6.0),
    ("de", 3500.0, 3725.75, 5.0),
    ("es", 4100.0, 4800.5, 8.0),
    ("xx", 5000.0, 5100.0, 2.0),
]
# Speakers of the lines made from line items: parts.
PART_MAIN = [str(i) for i in range(1, 51)]
TALK_ALIASES = [("asst", "assistant"), ("user", "user"), ("nobody", "no one")]
TALK_MAIN = ["user", "assistant"]

# Letters put for others, so that texts have scripts without blanks, and a word list for them.
SCRIPT_LETTERS = ("aeionst", "日本語ひカタก")
SCRIPT_WORDS = [(w,) for w in ["日本", "本語", "日本語", "語ก", "ひ日", "ひ日本", "本カ", "กก", "本本ก"]]

# Deals texts out to so many tasks; for files of few row groups. None leaves the scan as it is.
PARTITIONS: int | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is worked on."""
    df = table(spark, sf_dir, name)
    return df.repartition(PARTITIONS) if PARTITIONS else df


EVENT_ORDER = ["ts", "line_no"]


def event_text() -> Column:
    """A line of a transcript for each event: scene, action or speech."""
    props = F.col("props")
    shortened = (F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0)
    name = F.when(shortened, "Purc").otherwise(F.initcap("event_type"))
    return (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("[Scene: "), props, F.lit("]")))
        .when(F.col("event_type") == "error", F.concat(F.lit("(error "), props, F.lit(")")))
        .otherwise(F.concat(name, F.lit(": "), props))
    )


def event_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text per event. The line number is the event's id; the lines' order is
    ``EVENT_ORDER``, by time and then by id."""
    raw = text_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("title"),
        F.lpad((F.col("user_id") % 10).cast("string"), 2, "0").alias("season"),
        "ts",
        F.col("event_id").alias("line_no"),
        event_text().alias("text"),
    )
    return L.clean_text(raw)


def event_lines(spark: SparkSession, sf_dir: str, aliases: bool = True) -> DataFrame:
    lines = event_transcript(spark, sf_dir).transform(L.classify_lines).transform(L.split_speaker)
    if not aliases:
        return lines
    return lines.transform(L.replace_aliases, dims.literal_table(spark, ALIASES, dims.ALIASES))


def event_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scene_number(event_lines(spark, sf_dir), EVENT_ORDER)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of each document, spoken by the document's source in its language's season."""
    documents = text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("season"),
        F.col("source").alias("person"),
        "text",
    )
    lines = exploded(documents, F.split("text", "\n", -1), "line", "line_no", ["id", "season", "person"])
    return lines.withColumn("type", F.lit("person"))


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents, some letters as letters of scripts without blanks."""
    return document_lines(spark, sf_dir).withColumn("line", F.translate("line", *SCRIPT_LETTERS))


def crossed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw(page_id, file, html)``: paragraphs begin inside a font and a bold element that end before them."""
    opened = F.replace("html", F.lit("<p>"), F.lit('<font size="3"><b>\n<p></b>'))
    return raw_pages(spark, sf_dir).withColumn("html", F.replace(opened, F.lit("</p>"), F.lit("</font> left out</p>")))


def encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, content)``: the pages as bytes of three character sets, declared in different ways or not at all."""
    pages = text_table(spark, sf_dir, "pages").withColumn("kind", F.col("page_id") % 5)
    text = F.replace("html", F.lit('<meta charset="utf-8">'), F.lit(""))
    narrow = F.regexp_replace(text, "[^\\x{0}-\\x{7F}\\x{A0}-\\x{FF}]", "?")
    latin = F.concat(F.lit("<meta http-equiv='Content-Type' content='text/html; charset=iso-8859-1'>"), narrow)
    # a byte that is a dash in windows-1252
    windows = F.concat(F.lit('<META CHARSET="Windows-1252">\u0096'), narrow)
    undeclared = F.concat(F.lit("\u0096\u00E9"), narrow)
    content = (
        F.when(F.col("kind") == 0, F.encode(F.concat(F.lit("<meta charset=utf-8>"), text), "UTF-8"))
        .when(F.col("kind") == 1, F.encode(latin, "ISO-8859-1"))
        .when(F.col("kind") == 2, F.encode(windows, "ISO-8859-1"))
        .when(F.col("kind") == 3, F.encode(undeclared, "ISO-8859-1"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    return pages.select("page_id", content.alias("content"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("role").alias("person"),
        F.col("turn").alias("line_no"),
        F.col("text").alias("line"),
    )


def raw_pages(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """``raw(page_id, file, html)``; with ``broken``, line breaks part the paragraphs."""
    pages = text_table(spark, sf_dir, "pages").withColumnRenamed("url", "file")
    return pages.withColumn("html", F.replace("html", F.lit("</p><p>"), F.lit("<br>"))) if broken else pages


def talk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw(conv_id, file, html)``: a page per conversation, in the ways transcripts are written.

    A page has a title, a credit, a scene mark before every third turn, the turns as ``Role: text``,
    some of them as actions or as notes without a speaker, and, in a fifth of the pages, line breaks
    instead of paragraphs. Two pages share an id, and every fifth pair shares its file name too.
    Turns of a conversation are few.
    """
    turn, even = F.col("turn"), F.col("conv_id") % 2
    role = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 3 == 0), "Asst").otherwise(F.initcap("role"))
    said = F.concat(F.lit("<b>"), role, F.lit(":</b> "), F.coalesce("text", F.lit("")))
    said = F.when(turn % 7 == 5, F.concat(F.lit("("), F.col("role"), F.lit(" waits)"))).otherwise(said)
    said = F.when(turn % 7 == 6, F.concat(F.lit("7th note "), turn.cast("string"))).otherwise(said)
    mark = F.concat(F.lit("[Scene: part "), (turn / 3).cast("int").cast("string"), F.lit("]"))
    parts = F.when(turn % 3 == 1, F.array(mark, said)).otherwise(F.array(said))
    turns = table(spark, sf_dir, "conversations").withColumn("parts", parts)
    pages = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "parts"))).alias("turns"))
    lines = F.flatten(F.transform("turns", lambda t: t["parts"]))
    credit = F.concat(F.lit("Written by: crew "), F.col("conv_id").cast("string"))
    lines = F.concat(F.array(credit), lines)
    breaks = F.concat(F.lit("<p>start<br>"), F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "</?b>", "")), "<br>"), F.lit("<br>end</p>"))
    paragraphs = F.concat(F.lit("<p>"), F.array_join(lines, "</p>\n<p>"), F.lit("</p>"))
    body = F.when(F.col("conv_id") % 5 == 0, breaks).otherwise(paragraphs)
    head = F.concat(F.lit("<html><head><title>Talk "), F.col("conv_id").cast("string"), F.lit("</title></head><body>"))
    number = F.lpad((F.floor(F.col("conv_id") / 2) % 10_000).cast("string"), 4, "0")
    part = F.when((F.floor(F.col("conv_id") / 2) % 5 == 0) | (even == 0), "").otherwise("b")
    return pages.select(
        "conv_id", F.concat(number, part, F.lit(".html")).alias("file"), F.concat(head, body, F.lit("</body></html>")).alias("html")
    )


def talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = dims.literal_table(spark, TALK_ALIASES, dims.ALIASES)
    return L.lines_from_pages(talk_pages(spark, sf_dir).drop("conv_id"), aliases, min_paragraphs=3)


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each line item, spoken by its part."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("person"))
    return items.withColumn("type", F.lit("person"))


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order, as speakers in a scene."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("person"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands in an order, as speakers in a scene."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("person"))


def stop_words(spark: SparkSession) -> DataFrame:
    return dims.literal_table(spark, STOP_WORDS, dims.STOP_WORDS)


def script_words(spark: SparkSession) -> DataFrame:
    return dims.literal_table(spark, SCRIPT_WORDS, dims.STOP_WORDS)


def lexicon(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = {
        "score": (LEX_SCORE, dims.LEX_SCORE),
        "polarity": (LEX_POLARITY, dims.LEX_SENTIMENT),
        "emotion": (LEX_EMOTION, dims.LEX_SENTIMENT),
    }[name]
    return dims.literal_table(spark, rows, schema)


def pay(spark: SparkSession) -> DataFrame:
    return dims.literal_table(spark, PAY, dims.PAY)


def display_names(spark: SparkSession) -> DataFrame:
    return dims.literal_table(spark, DISPLAY_NAMES, dims.DISPLAY_NAMES)
