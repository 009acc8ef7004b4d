"""Pages to lines, one invented transcript per HTML format."""

import time

import pytest
from pyspark.sql import functions as F

from scriptweave.functions import html as H
from scriptweave.operators import lines as L, measures as M, words as W
from scriptweave.sources import dims
from scriptweave.sources.pages import read_pages, without_files

MIXED = """<html><head><title>The Lost Kettle</title></head><body>
<p>Written by: Ann Poe</p>
<p>[Scene: Kitchen, Mia is reading.]</p>
<p><b>Mia:</b> It's cold
today. "Really" cold.</p>
<p>(Tom enters)</p>
<p><b>Tom:</b> (at the door) Hello.</p>
<p>[Later.]</p>
<p><b>Mia:</b> One rule: never run.</p>
<p><b>1st Guest:</b> Hi.</p>
<p> </p>
</body></html>"""

EXPECTED = [
    (1, "written", "written by", "ann poe", 0),
    (2, "scene", "[scene", "kitchen, mia is reading.]", 1),
    (3, "person", "mia", "it's cold today. really cold.", 1),
    (4, "action", "(tom enters)", None, 1),
    (5, "scene", "tom", "(at the door) hello.", 2),
    (6, None, "[later.]", None, 2),
    (7, "person", "mia", "one rule", 2),
    (8, None, "1st guest", "hi.", 2),
]


def raw(spark, *pages):
    return spark.createDataFrame(list(pages), "file string, html string")


def lines(df, *columns):
    return [tuple(r) for r in df.orderBy("source_file", "line_no").select(*columns).collect()]


def test_mixed_tags(spark):
    df = L.lines_from_pages(raw(spark, ("0101.html", MIXED)), min_paragraphs=5)
    assert lines(df, "line_no", "type", "person", "line", "scene") == EXPECTED
    assert {tuple(r) for r in df.select("id", "season", "title", "source_file").collect()} == {
        ("0101", "01", "The Lost Kettle", "0101.html")
    }


def test_newline_deleted(spark):
    df = L.lines_from_pages(raw(spark, ("0101.html", MIXED)), min_paragraphs=5, newline="delete")
    assert lines(df, "line")[2] == ("it's coldtoday. really cold.",)
    with pytest.raises(ValueError):
        L.clean_text(df, "line", newline="keep")


def test_keep_rest(spark):
    df = L.lines_from_pages(raw(spark, ("0101.html", MIXED)), min_paragraphs=5, keep_rest=True)
    assert lines(df, "line")[6] == ("one rule: never run.",)


def test_plain_speaker_upper_case_without_scenes(spark):
    page = "<p>MIA: Hey.</p>\n<p>TOM: You or me?</p>"
    df = L.lines_from_pages(raw(spark, ("0203.html", page)), min_paragraphs=0)
    assert lines(df, "person", "line", "scene", "title") == [("mia", "hey.", 0, None), ("tom", "you or me?", 0, None)]


BROKEN = """<p>Written by A<br>
B <i>and <br> C</i></p>
<p align="left">[Scene: a room.]<br>
<br>
MNCA: OK, is it <b>really</b> me?<br>
<br>
ROSS: No.<br>
TOM: last</p>"""


def test_text_between_breaks(spark):
    aliases = dims.literal_table(spark, [("mnca", "monica"), ("ross", "ross")], dims.ALIASES)
    df = L.lines_from_pages(raw(spark, ("0207.html", BROKEN)), aliases)
    # first and last part of a paragraph go, a child element goes and parts its text
    assert lines(df, "person", "line", "type") == [
        ("monica", "ok, is it", "person"),
        ("me?", None, None),
        ("ross", "no.", "person"),
    ]


def test_bold_outside_and_entities(spark):
    page = "<b>\n\n<p>Joey: </b>There&#146;s &quot;one&quot; &amp;lt; R&#x26;B &nosuch; &#0;&#99999999;x&nbsp;</p>"
    df = L.lines_from_pages(raw(spark, ("0816.html", page)), min_paragraphs=0)
    assert lines(df, "person", "line") == [("joey", "theres one &lt; r&b &nosuch; x")]


def test_stray_closing_tags(spark):
    page = "<font>HEAD</font></p>Teleplay by: X</p></p><p>[Scene: Home]</p><p>Mia: Hey!</p>"
    df = L.lines_from_pages(raw(spark, ("0911.html", page)), min_paragraphs=0)
    assert lines(df, "person", "line", "scene") == [("[scene", "home]", 1), ("mia", "hey!", 1)]


def test_scripts_and_comments_hold_no_paragraphs(spark):
    page = '<style>p{}</style><script>var t="<p>no</p>";</script><!-- <p>no</p> --><p>Mia: a < 3 & b</p><pre>x</pre>'
    df = L.html_paragraphs(raw(spark, ("a", page)), 0)
    # the paragraph is not closed by <pre>: it ends at its own closing tag
    assert [r.text for r in df.collect()] == ["Mia: a < 3 & b"]


def test_unclosed_paragraph_runs_to_the_next(spark):
    df = L.html_paragraphs(raw(spark, ("a", "<p>one<p class='x'>two</P ><p>three")), 0)
    assert sorted((r.para_no, r.text) for r in df.collect()) == [(1, "one"), (2, "two"), (3, "three")]


def test_ids(spark):
    names = ["0212-0213.html", "x/0101uncut.html", "no digits", "a-b 0307.html"]
    from scriptweave.functions import text as X

    df = spark.createDataFrame([(n,) for n in names], "n string").select(X.id_from_name(F.col("n")).alias("i"))
    assert [r.i for r in df.collect()] == ["0212-0213", "0101", "no digits", "a-b 0307.html"]


def test_scenes_of_an_id_with_several_files(spark):
    first = "<p>[Scene: a]</p><p>Mia: x</p><p>[Scene: b]</p>"
    second = "<p>Tom: y</p><p>[Scene: c]</p><p>Tom: z</p>"
    pages = [("0101a.html", first), ("0101b.html", "<p>Mia: none</p>"), ("0101c.html", second), ("0102.html", second)]
    df = L.lines_from_pages(raw(spark, *pages), min_paragraphs=0)
    assert lines(df, "source_file", "scene") == [
        ("0101a.html", 1), ("0101a.html", 1), ("0101a.html", 2),
        ("0101b.html", 2),
        ("0101c.html", 2), ("0101c.html", 3), ("0101c.html", 3),
        ("0102.html", 0), ("0102.html", 1), ("0102.html", 1),
    ]


def test_scene_number_agrees_with_pages(spark):
    page = "".join(f"<p>{'[Scene: s]' if i % 7 == 3 else f'Mia: line {i}'}</p>" for i in range(200))
    df = L.lines_from_pages(raw(spark, ("0101.html", page), ("0102.html", page)))
    again = L.scene_number(df.withColumnRenamed("scene", "narrow"), ranges=10)
    assert again.filter("scene <> narrow").count() == 0 and again.count() == 400


def test_very_long_texts(spark):
    """No regular expression may recurse once per character or scan a run of blanks again and again."""
    n = 200_000
    texts = ["a." * n, "a1" * n, "." * n, " " * n + "x", "&" * n, "<p>" + "x" * n, "x: " + ":" * n]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, html string")
    assert L.clean_text(df.withColumnRenamed("html", "text")).count() == len(texts)
    from scriptweave.operators.words import tokenize

    words = tokenize(df.select("file", F.col("html").alias("line")))
    assert dict(words.groupBy("file").count().collect()) == {"0": 1, "1": 1, "3": 1, "5": 2, "6": 1}
    assert L.html_paragraphs(df, 0).count() == 1


def test_openings_never_closed(spark):
    """Nor may it read on to the end of the page from each of many openings."""
    n = 200_000
    texts = [x * n for x in ("<script ", "<script>", "<!-- ", "<title ", "<title>", "<p ", "<a ", "<a>", "<br ", "<style>", "</p ")]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, html string")
    start = time.perf_counter()
    assert L.html_paragraphs(df, 20).count() >= 0
    assert df.select(H.title(F.col("html")).alias("t")).filter("t is not null").count() == 1
    assert time.perf_counter() - start < 60


def test_block_elements_end_a_paragraph(spark):
    page = "<p>one<div>no</div><p>two<table><tr><td>no</td></tr></table><P>three<H2>no</H2><p>four<ul><li>no</ul><p>five <span>x</span></p>"
    df = L.html_paragraphs(raw(spark, ("a", page)), 0)
    assert [r.text for r in df.orderBy("para_no").collect()] == ["one", "two", "three", "four", "five x"]


def test_unclosed_script_and_comment_run_to_the_end(spark):
    pages = [("a", "<p>x</p><script><p>no</p>"), ("b", "<p>y</p><!-- <p>no</p>"), ("c", "<title>T")]
    df = raw(spark, *pages)
    assert sorted(r.text for r in L.html_paragraphs(df, 0).collect()) == ["x", "y"]
    assert {r.t for r in df.select(H.title(F.col("html")).alias("t")).collect()} == {None, "T"}


def test_repeated_file_names(spark):
    """Two pages of one name and one id: no row more than they have, and numbers go on."""
    pages = [("0101.html", "<p>[Scene: a]</p><p>Mia: x</p>"), ("0101.html", "<p>[Scene: b]</p><p>Tom: y</p>")]
    df = L.lines_from_pages(raw(spark, *pages), min_paragraphs=0)
    assert sorted((r.line_no, r.scene) for r in df.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    same = L.lines_from_pages(raw(spark, pages[0], pages[0]), min_paragraphs=0)
    assert sorted((r.line_no, r.scene) for r in same.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_line_numbers_of_an_id_with_several_files(spark):
    page = "<p>Mia: a b</p><p>Mia: c</p><p>Mia: d</p>"
    df = L.lines_from_pages(raw(spark, ("0101a.html", page), ("0101b.html", page)), min_paragraphs=0)
    spoken = W.spoken_by_main(df, ["mia"])
    numbered = W.number_lines(spoken).orderBy("source_file", "line_no")
    assert [(r.line_no, r.total_line, r.episode_line) for r in numbered.collect()] == [(i, i, i) for i in range(1, 7)]
    recon = M.token_line_recon(spoken, W.tokenize(spoken)).collect()
    assert [(r.n_lines, r.n_token_lines) for r in recon] == [(6, 6)]


def test_lines_of_new_pages(spark):
    """Files that come later, in three steps, against all at once."""
    page = "<title>T</title><p>[Scene: {0}]</p><p><b>Mia:</b> {0}.</p><p> </p><p><b>Tom:</b> Yes.</p><p>[Scene: x]</p><p>(goes)</p>"
    files = [(f"{n}{part}.html", page.format(f"{n}{part}{i}")) for part in "abc" for n in ("0101", "0102", "0203") for i in range(2)]
    files += [("0101c.html", files[-1][1]), ("0101c.html", files[-1][1]), ("0304.html", ""), ("0304b.html", None)]
    whole = L.lines_from_pages(raw(spark, *files), min_paragraphs=0)
    known, steps = None, []
    for part in "abc":
        df = raw(spark, *[f for f in files if f[0][4] <= part])  # those of earlier steps are passed over
        lines, known = L.lines_of_new_pages(df, known, min_paragraphs=0)
        steps.append(lines)
    assert sorted(map(str, L.union_sources(*steps).select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert min(r.line_no for r in steps[1].filter("id = '0101'").collect()) == known.filter("source_file = '0101a.html'").agg(F.sum("n_lines")).first()[0] + 1
    none, still = L.lines_of_new_pages(raw(spark, *files), known, min_paragraphs=0)
    assert none.count() == 0 and still.count() == known.count() == len(files)
    changed, more = L.lines_of_new_pages(raw(spark, ("0102a.html", page.format("new"))), known, min_paragraphs=0)
    assert changed.count() == 5 and changed.agg(F.min("scene")).first()[0] == 13 and more.count() == len(files) + 1


def test_title_keeps_its_form(spark):
    df = raw(spark, ("a", "<TITLE>\n A &amp; B \n</title>"), ("b", "<p>x</p>")).select(H.title(F.col("html")).alias("t"))
    assert sorted((r.t for r in df.collect()), key=str) == ["\n A & B \n", None]


def test_read_pages(spark, tmp_path):
    (tmp_path / "0101.html").write_bytes(MIXED.encode())
    (tmp_path / "0102.html").write_bytes("<title>Café “1”</title><p>Mia: hi</p>".encode("windows-1252"))
    (tmp_path / "0103.html").write_bytes(b"<p>left out</p>")
    kept = without_files(read_pages(spark, str(tmp_path), "windows-1252"), ["0103.html"])
    assert sorted(r.file for r in kept.collect()) == ["0101.html", "0102.html"]
    assert {r.title for r in L.lines_from_pages(kept, min_paragraphs=0).collect()} == {"The Lost Kettle", "Café “1”"}
    assert without_files(kept, []).count() == 2
    with pytest.raises(ValueError):
        read_pages(spark, str(tmp_path), "gb18030")


def test_union_sources_fills_missing_columns(spark):
    a = spark.createDataFrame([("1", "x")], "id string, line string")
    b = spark.createDataFrame([("y", "2", "s")], "line string, id string, season string")
    assert sorted(tuple(r) for r in L.union_sources(a, b).collect()) == [("1", "x", None), ("2", "y", "s")]


def test_split_paragraphs(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n\n")], "k int, text string")
    assert [tuple(r) for r in L.split_paragraphs(df).collect()] == [(1, "a", 1), (1, "b", 2), (1, "", 3)]
