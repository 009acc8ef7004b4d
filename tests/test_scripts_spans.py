"""Words of scripts without blanks, spans of nearest points, crossed tags, character sets, malformed rows, speakers
found in the data, exact quantiles and repeated keys, against brute force or expected rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptweave.functions import html as H, text as X
from scriptweave.functions.segments import Trie, is_katakana, is_mark, is_unspaced, segments
from scriptweave.operators import lines as L, measures as M, pairs, quantiles, words as W
from scriptweave.operators.trend import trend_span
from scriptweave.sources import lines as lines_io
from scriptweave.sources.pages import read_pages, with_text


# -- scripts ------------------------------------------------------------------------------


def brute_words(text, listed):
    """Letter by letter, trying every word of the list; one that goes on in another script is none."""
    out, at = [], 0
    listed = [w for w in listed if all(is_unspaced(x) or is_mark(x) for x in w)]

    def longest(i):
        fits = [w for w in listed if text.startswith(w, i) and not (i + len(w) < len(text) and is_mark(text[i + len(w)]))]
        return max(fits, key=len, default="")

    while at < len(text):
        if text[at] == " ":
            at += 1
        elif not is_unspaced(text[at]):
            end = at
            while end < len(text) and text[end] != " " and not is_unspaced(text[end]):
                end += 1
            out.append(text[at:end])
            at = end
        else:
            word = longest(at)
            if not word:
                word = text[at]
                while is_katakana(text[at]) and at + len(word) < len(text) and is_katakana(text[at + len(word)]) and not longest(at + len(word)):
                    word += text[at + len(word)]
                while at + len(word) < len(text) and is_mark(text[at + len(word)]):
                    word += text[at + len(word)]
            out.append(word)
            at += len(word)
    return out


def test_scripts(spark):
    rng = random.Random(4)
    listed = ["日本", "日本語", "本語", "カタ", "ラー", "กิน", "ข้าว", "ひら", "語abc"]
    letters = list("日本語ひらカタラー") + ["กิ", "น", "ข้", "า", "ว", "abc", "x1", " ", " "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    texts += ["", None, "日本語", "plain words only"]
    words = spark.createDataFrame([(w,) for w in [*listed, listed[0], None, ""]], "word string")
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, line string")
    found = {}
    for r in W.tokenize_scripts(lines, words).orderBy("k", "word_no").collect():
        found.setdefault(r.k, []).append(r.word)
    for k, text in enumerate(texts):
        assert found.get(k, []) == ([None] if text is None else brute_words(text, listed)), text
    alone = W.tokenize_scripts(lines.filter("line = '日本語'")).collect()
    assert [r.word for r in alone] == ["日", "本", "語"]


@pytest.mark.parametrize("letters_of_a_pattern", [20_000, 0])
def test_scripts_by_pattern_and_by_trie(spark, monkeypatch, letters_of_a_pattern):
    """Rare letters, long runs, many words of one beginning, words that begin others: both ways as letter by letter."""
    monkeypatch.setattr(W, "PATTERN_LETTERS", letters_of_a_pattern)
    rng = random.Random(9)
    letters = list("日本語ひカー") + [chr(0x4E00 + k) for k in range(40)] + ["\U00020000", "กิ", "\u3099", "ก", "〆", "ｰ", "ｶ", "\U00016FE3", "a", "é", "b1"]
    listed = {"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(400)} | {"日" * k for k in (1, 2, 30)} | {"a b", "カ 日", "(.*", "\\"}
    texts = ["".join(rng.choice([*letters, *listed, " ", "."]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["カ" * 50_000 + "本", "日" * 50_000, "〆abc", "〆abc日", "X日\u0301\u0301", None]
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, line string")
    words = spark.createDataFrame([(w,) for w in listed], "word string")
    rows = W.tokenize_scripts(lines, words)
    assert ("ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()) == (letters_of_a_pattern == 0)
    found = {}
    for r in rows.orderBy("k", "word_no").collect():
        found.setdefault(r.k, []).append(r.word)
    unspaced, trie = F.col("line").rlike(f"[{X._UNSPACED}]"), Trie(listed)
    piece = rf"[{X._UNSPACED}][{X._UNSPACED}\p{{M}}]*|[^{X._UNSPACED}]+"
    parts = F.transform(X.tokens(F.col("line")), lambda w: F.regexp_extract_all(w, F.lit(piece), F.lit(0)))
    for r in lines.select("k", unspaced.alias("has"), X.tokens(F.col("line")).alias("tokens"), F.flatten(parts).alias("parts")).collect():
        wanted = [w for x in r.parts for w in segments(x, trie)] if r.has else r.tokens
        assert found.get(r.k, []) == wanted, texts[r.k]


def test_word_list_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(W, "MAX_WORDS", 2)
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    with pytest.raises(ValueError):
        W.tokenize_scripts(spark.createDataFrame([(1, "日")], "k int, line string"), words)


# -- spans --------------------------------------------------------------------------------


def brute_span(points, span, cell):
    cells, out = math.ceil(1 / (span * cell)), {}
    points = sorted(points)
    total, xs = len(points), sorted({x for x, _ in points})
    q = min(total, max(2, math.floor(span * total + 1e-9)))
    vertices = []
    for x in xs:
        before, here = sum(p < x for p, _ in points), sum(p == x for p, _ in points)
        if x in (xs[0], xs[-1]) or (before + here) * cells // total > before * cells // total:
            vertices.append(x)
    fits = []
    for v in vertices:
        h = sorted(abs(x - v) for x, _ in points)[q - 1]
        near = [(x - v, y) for x, y in points if abs(x - v) < h or x == v]
        weights = [(1 - (abs(d) / h if d else 0) ** 3) ** 3 for d, _ in near]
        s = [sum(w * d**k for w, (d, _) in zip(weights, near)) for k in range(3)]
        t = [sum(w * d**k * y for w, (d, y) in zip(weights, near)) for k in range(2)]
        spread = s[0] * s[2] - s[1] ** 2
        fits.append(((s[2] * t[0] - s[1] * t[1]) / spread, (s[0] * t[1] - s[1] * t[0]) / spread) if spread > 1e-9 else (t[0] / s[0], 0))
    for x in xs:
        i = max(k for k, v in enumerate(vertices) if v <= x)
        if i == len(vertices) - 1:
            out[x] = fits[i][0]
            continue
        width = vertices[i + 1] - vertices[i]
        u = (x - vertices[i]) / width
        out[x] = (
            (2 * u**3 - 3 * u**2 + 1) * fits[i][0] + (u**3 - 2 * u**2 + u) * width * fits[i][1]
            + (3 * u**2 - 2 * u**3) * fits[i + 1][0] + (u**3 - u**2) * width * fits[i + 1][1]
        )
    return out


@pytest.mark.parametrize("span, cell", [(0.75, 0.2), (0.3, 0.5)])
def test_span(spark, span, cell):
    rng = random.Random(1)
    rows = [(g, x, rng.gauss(x / 10, 1)) for g in ("a", None) for x in sorted(rng.choices(range(0, 300, 7), k=70))]
    rows += [("sparse", x, float(x * x)) for x in (1, 2, 1000, 5000, 5001)]
    rows += [("one", 5, 1.0), ("one", 5, 3.0), ("two", 1, 1.0), ("two", 9, 2.0), ("none", None, 1.0), ("none", 3, None)]
    found = {(r.g, r.x): r.trend for r in trend_span(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "x", "y", span, cell).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        points = [(x, y) for gg, x, y in rows if gg == g and x is not None and y is not None]
        if points:
            expected |= {(g, x): t for x, t in brute_span(points, span, cell).items()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[k], expected[k], rel_tol=1e-9, abs_tol=1e-9) for k in expected)


def test_span_follows_a_line(spark):
    rows = [("a", x, 2.0 * x + 1) for x in (0, 1, 5, 40, 41, 90, 200)]
    found = trend_span(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "x", "y")
    assert all(math.isclose(r.trend, 2 * r.x + 1) for r in found.collect())


# -- crossed tags -------------------------------------------------------------------------


@pytest.mark.parametrize("html, expected", [
    ('<font size="3"><b>\n\n<p></b>By: A &amp; B</font> <br>\n<font>C</font></p><hr>', ["By: A & B"]),
    ('<font size="3">\n\n<p align="left">[Scene x]</font></p> out', ["[Scene x]"]),
    ("<b>\n\n<p>Joey: </b>There</p>\n<b>\n<p>Ross: </b>So</p>", ["Joey: There", "Ross: So"]),
    ("<p>one<p>two<div>out</div></p><p>three", ["one", "two", "three"]),
    ("<table><tr><td><p>a</table>b</p>", ["a"]),
    ("<p>x</b>y</p></p>z", ["xy"]),
    ("<p><i>a<table><tr><td></i>b</td></tr></table>", ["a"]),
    ("<P>a<BR>b <img src=x>c</P>", ["ab c"]),
    ("<p>1 < 2 & 3 > 2</p>", ["1 < 2 & 3 > 2"]),
    ("no paragraph", []),
    ("", []),
    (None, None),
])
def test_crossed(spark, html, expected):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(H.texts_of(H.crossed_paragraph_bodies(F.col("html"))).alias("t")).first().t == expected


def test_crossed_as_plain(spark):
    """Without crossing both readings agree, also in a long page."""
    html = "<html><body>" + "".join(f"<p><b>n{i}:</b> said <i>so</i></p>\n" for i in range(2000)) + "</body></html>"
    raw = spark.createDataFrame([("f", html)], "file string, html string")
    both = [[tuple(r) for r in L.html_paragraphs(raw, crossed=c).orderBy("para_no").collect()] for c in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 2000


# -- character sets -----------------------------------------------------------------------


def test_charsets(spark, tmp_path):
    body = "Café – “so” €"
    files = {
        "utf8.html": ("<meta charset='utf-8'>" + body).encode(),
        "win.html": ('<meta HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=windows-1252">' + body).encode("windows-1252"),
        "latin.html": ('<meta http-equiv="Content-Type" content="text/html; charset=iso-8859-1">Café').encode("iso-8859-1"),
        "cyrillic.html": ("<meta charset=koi8-r>Привет").encode("koi8-r"),
        "marked.html": b"\xef\xbb\xbf" + body.encode(),
        "wide.html": b"\xff\xfe" + body.encode("utf-16-le") + b"x",
        "bare_utf8.html": body.encode(),
        "bare_win.html": body.encode("windows-1252"),
        "wrong.html": ("<meta charset=utf-8>" + body).encode("windows-1252"),
        "unknown.html": ("<meta charset=x-nothing>" + body).encode(),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.file: r.html for r in read_pages(spark, str(tmp_path), None).collect()}
    assert all(found[n].endswith(body) for n in files if n not in ("latin.html", "cyrillic.html"))
    assert found["latin.html"].endswith(">Café") and found["cyrillic.html"].endswith("Привет")
    assert found["marked.html"] == body and found["wide.html"] == body
    nothing = spark.createDataFrame([(None,)], "content binary")
    assert with_text(nothing).first().text is None


# -- malformed rows -----------------------------------------------------------------------


def test_malformed_rows(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [("1", "t", n, "mia", 'say "a",\nb', None if n % 2 else "person", "01", 2, "f") for n in range(10)]
    good = spark.createDataFrame(rows, lines_io.LINES)
    lines_io.write_lines(good, path, "csv")
    bad = ["1,t", "1,t,ten,mia,hi,person,2,f", "1,t,1,mia,hi,person,2,f,more,and more"]
    lines_io.write_rows(spark.createDataFrame([(b,) for b in bad], "value string"), path, "02")
    read, rejected = lines_io.read_lines_checked(spark, path)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)
    assert sorted((r.bad_row, r.season) for r in rejected.collect()) == sorted((b, "02") for b in bad)
    assert M.count_by(read, "type").filter("type is null").first().n == 5


# -- all speakers -------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4, 128])
def test_all_speakers(spark, block):
    rng = random.Random(block)
    rows = [(rng.randrange(25), rng.randrange(40)) for _ in range(300)] + [(99, i) for i in range(200)] + [(None, 1), (None, 2), (3, None)]
    casts = {}
    for scene, person in rows:
        if person is not None:
            casts.setdefault(scene, set()).add(person)
    expected = Counter((a, b) for cast in casts.values() for a in cast for b in cast if a > b)
    df = spark.createDataFrame(rows + rows[:30], "id int, person int").repartition(5)
    found = pairs.cooccurrence_all(df, ["id"], block=block)
    assert {(r.person_a, r.person_b): r.n for r in found.collect()} == expected
    assert pairs.cooccurrence_all(df.limit(0), ["id"]).count() == 0


def test_a_cast_of_thousands(spark):
    """One order of 4,000 parts: all its pairs, counted."""
    df = spark.range(4_000).select(F.lit(1).alias("id"), F.col("id").alias("person"))
    found = pairs.cooccurrence_all(df, ["id"], block=500)
    assert tuple(found.agg(F.count(F.lit(1)), F.sum("n"), F.min(F.col("person_a") - F.col("person_b"))).first()) == (7_998_000, 7_998_000, 1)


# -- exact quantiles ----------------------------------------------------------------------


def test_quantiles(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.choice([-5, 3, 3, 10**12, rng.randrange(10**6)]) for _ in range(999)]
    df = spark.createDataFrame([(v, 1) for v in values] + [(None, 1)], "v long, w int")
    for q in (0.0, 0.05, 0.5, 0.95, 0.951, 1.0):
        assert math.isclose(quantiles.exact_quantile(df, "v", q), np.quantile(values, q), rel_tol=1e-12)
    weighted = spark.createDataFrame(list(Counter(values).items()), "v long, n long")
    monkeypatch.setattr(quantiles, "BUCKETS", 2)
    assert math.isclose(quantiles.exact_quantile(weighted, "v", 0.4, "n"), np.quantile(values, 0.4))
    assert quantiles.exact_quantile(df.limit(0), "v", 0.5) is None


# -- repeated keys and seasons ------------------------------------------------------------


def test_repeated_keys(spark):
    rows = [("1", 1, "s", "p", "a"), ("1", 1, "s", "p", "a"), ("1", 1, "s", "p", "b"), ("1", 2, "s", "q", "c"), (None, None, "s", "p", "z"), ("1", 3, "s", "p", None)]
    for order in (rows, rows[::-1]):
        lines = spark.createDataFrame(order, "id string, line_no int, season string, person string, line string").repartition(3)
        found = W.number_lines(lines).collect()
        assert Counter((r.id, r.line_no, r.line) for r in found) == Counter((r[0], r[1], r[4]) for r in rows)
        assert sorted(r.total_line for r in found if r.person == "p") == [1, 2, 3, 4, 5]
        assert sorted(r.episode_line for r in found if r.id == "1" and r.person == "p") == [1, 2, 3, 4]
    typed = [("1", 1, "scene"), ("1", 1, "scene"), ("1", 2, None), ("2", 1, "scene")]
    scenes = L.scene_number(spark.createDataFrame(typed, "id string, line_no int, type string")).collect()
    assert sorted((r.id, r.line_no, r.scene) for r in scenes) == [("1", 1, 1), ("1", 1, 2), ("1", 2, 2), ("2", 1, 1)]


def test_season_number(spark):
    df = spark.createDataFrame([("01",), ("pi",), (None,), ("10",)], "season string")
    assert [r.season for r in M.with_season_number(df).collect()] == [1, None, None, 10]
