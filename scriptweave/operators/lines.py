"""Pages to paragraphs to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import html as H, text as X
from .durable import durable
from .numbering import preceding_totals, with_running_totals
from .steps import computed_once, exploded


def html_paragraphs(raw: DataFrame, min_paragraphs: int = K.MIN_PARAGRAPHS, crossed: bool = False) -> DataFrame:
    """One row per paragraph of ``raw(file, html)``: number and text. A narrow step. With ``crossed``, the end
    of an element around a paragraph ends it too."""
    keep = [c for c in raw.columns if c != "html"]
    find = H.crossed_paragraph_bodies if crossed else H.paragraph_bodies
    bodies = computed_once(raw, "html", find(F.col("html")))
    paragraphs = H.paragraphs_of(F.col("html"), min_paragraphs)
    return exploded(bodies, paragraphs, "text", "para_no", keep)


def clean_text(df: DataFrame, column: str = "text", newline: str = "space") -> DataFrame:
    """Cleans a column and drops rows left without any text."""
    return computed_once(df, column, X.clean(F.col(column), newline)).filter(F.length(column) > 0)


def classify_lines(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("type", X.line_type(F.col(column)))


def split_speaker(df: DataFrame, column: str = "text", keep_rest: bool = False) -> DataFrame:
    text = F.col(column)
    split = df.withColumns({"person": X.speaker(text), "line": X.spoken_text(text, keep_rest)})
    return split.drop(column)


def replace_aliases(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Full names for aliases, everywhere. ``aliases`` is a literal table of a few names."""
    named = lines.join(aliases, F.col("person") == F.col("alias"), "left")
    return named.withColumn("person", F.coalesce("full_name", "person")).drop("alias", "full_name")


def scene_number(lines: DataFrame, order: list[str] = ["line_no"], ranges: int | None = None) -> DataFrame:
    """Number of the current scene within each id: scene markers up to and with this line.
    ``order`` tells the lines of an id apart."""
    marker = F.when(F.col("type") == "scene", 1).otherwise(0)
    return with_running_totals(lines, ["id", *order], {"scene": (["id"], marker)}, ranges)


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def _page_texts(raw: DataFrame, newline: str, min_paragraphs: int) -> DataFrame:
    """Per page its cleaned texts and the places of those that begin a scene. Each page is parsed once."""
    pages = raw.select(
        F.col("file").alias("source_file"),
        X.id_from_name(F.col("file")).alias("id"),
        H.title(F.col("html")).alias("title"),
        H.paragraph_bodies(F.col("html")).alias("texts"),
        _digest().alias("digest"),
    ).withColumn("season", X.season_of(F.col("id")))

    def cleaned(paragraph: Column) -> Column:
        return X.clean(paragraph, newline)

    pages = computed_once(pages, "texts", F.col("texts"))
    pages = computed_once(pages, "texts", F.transform(H.paragraphs_of(F.col("texts"), min_paragraphs), cleaned))
    starts = F.transform("texts", lambda t, i: F.when(X.line_type(t) == "scene", i))
    return computed_once(pages, "starts", F.array_compact(starts))


def _lines_of(pages: DataFrame, keep_rest: bool, aliases: DataFrame | None) -> DataFrame:
    """The pages' lines, numbered on from ``before_lines`` and ``before_scenes``.

    A page is one row, so its scenes are found before its lines part: the texts of a page are
    cut where a scene begins, and the place of a piece is its scene number. Nothing is shuffled.
    """
    keep = ["source_file", "id", "title", "season", "before_lines", "before_scenes"]
    pages = computed_once(pages, "starts", F.concat(F.array(F.lit(0)), "starts"))

    def piece(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("texts"))
        return F.struct(start.alias("start"), F.slice("texts", start + 1, end - start).alias("texts"))

    scenes = exploded(pages, F.transform("starts", piece), "piece", "scene", keep)
    lines = exploded(scenes, F.col("piece.texts"), "text", "place", [*keep, "scene", "piece.start"])
    lines = (
        lines.filter(F.length("text") > 0)
        .withColumn("line_no", F.col("before_lines") + F.col("start") + F.col("place"))
        .withColumn("scene", F.col("before_scenes") + F.col("scene") - 1)
        .drop("start", "place", "before_lines", "before_scenes")
        .transform(classify_lines)
        .transform(split_speaker, keep_rest=keep_rest)
    )
    return lines if aliases is None else replace_aliases(lines, aliases)


def parse_pages(
    raw: DataFrame,
    aliases: DataFrame | None = None,
    newline: str = "space",
    min_paragraphs: int = K.MIN_PARAGRAPHS,
    keep_rest: bool = False,
) -> DataFrame:
    """Lines of ``raw(file, html)`` with lines and scenes numbered within their file."""
    zero = F.lit(0).cast("long")
    pages = _page_texts(raw, newline, min_paragraphs).withColumns({"before_lines": zero, "before_scenes": zero})
    return _lines_of(pages.drop("digest"), keep_rest, aliases)


def lines_from_pages(
    raw: DataFrame,
    aliases: DataFrame | None = None,
    newline: str = "space",
    min_paragraphs: int = K.MIN_PARAGRAPHS,
    keep_rest: bool = False,
) -> DataFrame:
    """The lines table of ``raw(file, html)``, lines and scenes numbered per id.

    Parsed pages are kept on storage. Of each, a narrow row with its numbers of texts and scenes
    is put in order by id and file name, and says where the page's numbers begin; files of one
    name are ordered by their content. Pages have a number of their own, so a repeated name or
    page multiplies nothing.
    """
    pages, narrow = _kept_pages(raw, newline, min_paragraphs)
    before = _before(narrow).select("page", "before_lines", "before_scenes")
    return _lines_of(pages.join(before, "page").drop("page", "digest"), keep_rest, aliases)


def _kept_pages(raw: DataFrame, newline: str, min_paragraphs: int) -> tuple[DataFrame, DataFrame]:
    """The parsed pages on storage, and a narrow row for each with its numbers of texts and scenes."""
    pages = _page_texts(raw, newline, min_paragraphs).withColumn("page", F.monotonically_increasing_id())
    pages = durable(pages, "pages")
    sizes = {"n_lines": F.size("texts").cast("long"), "n_scenes": F.size("starts").cast("long")}
    return pages, pages.select("page", "id", "source_file", "digest", *[c.alias(n) for n, c in sizes.items()])


def _before(narrow: DataFrame) -> DataFrame:
    """Adds the texts and scenes of the id's pages before each page."""
    order = [F.col(c) for c in ("id", "source_file", "digest", "page")]
    totals = {"before_lines": (["id"], "n_lines"), "before_scenes": (["id"], "n_scenes")}
    return preceding_totals(narrow, order, totals)


def lines_of_new_pages(
    raw: DataFrame,
    known: DataFrame | None = None,
    aliases: DataFrame | None = None,
    newline: str = "space",
    min_paragraphs: int = K.MIN_PARAGRAPHS,
    keep_rest: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The lines of those pages of ``raw(file, html)`` that are not known yet, and what is known then: (lines, known).

    ``known`` is what an earlier call gave, to be kept beside the table of lines: a narrow row for each page with
    its id, name, digest and numbers of texts and scenes. A page of a known name and content is passed over, neither
    parsed nor kept again, so ``raw`` may be the whole folder. New pages of an id are in order by name, and numbered on
    behind all its known pages, whatever the names of those. A page whose content has changed is a new page; its
    old lines stay where they are.
    """
    if known is not None:
        key = ["file", "digest"]
        found = raw.select("file", _digest().alias("digest")).distinct()
        fresh = found.join(known.select(F.col("source_file").alias("file"), "digest"), key, "left_anti")
        raw = raw.withColumn("digest", _digest()).join(durable(fresh, "fresh"), key, "left_semi").drop("digest")
    pages, narrow = _kept_pages(raw, newline, min_paragraphs)
    before = _before(narrow)
    if known is not None:
        held = known.groupBy(F.col("id").alias("_id")).agg(F.sum("n_lines").alias("_lines"), F.sum("n_scenes").alias("_scenes"))
        before = before.join(held, F.col("id").eqNullSafe(F.col("_id")), "left")
        for name, more in (("before_lines", "_lines"), ("before_scenes", "_scenes")):
            before = before.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    lines = _lines_of(pages.join(before.select("page", "before_lines", "before_scenes"), "page").drop("page", "digest"), keep_rest, aliases)
    narrow = durable(narrow.drop("page"), "known")
    return lines, narrow if known is None else known.select(*narrow.columns).unionByName(narrow)


def split_paragraphs(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per part of a text between blank lines."""
    keep = [c for c in df.columns if c != column]
    return exploded(df, F.split(F.col(column), "\n\n", -1), column, "para_no", keep)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Tables stacked by column name; a column a table lacks is NULL."""
    stacked = sources[0]
    for other in sources[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked
