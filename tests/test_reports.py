"""Reports on small invented tables, against expected rows and brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scriptweave import constants as K
from scriptweave.operators import distinctive as D
from scriptweave.operators import measures as M
from scriptweave.operators import pairs
from scriptweave.operators import pay as P
from scriptweave.operators import sentiment as S
from scriptweave.operators import vocabulary as V
from scriptweave.operators import words as Words
from scriptweave.operators.trend import trend_smooth
from scriptweave.sources import dims
from scriptweave.sources.lines import read_lines, write_lines

LINES = "id string, season string, line_no long, person string, line string, type string"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_tokens(spark):
    texts = ["don't go, 2 kettles", "u.s.a. rocks", "well-known snake_case", "?!", None, "1,000.5 a.1 it’s", ""]
    df = table(spark, list(enumerate(texts)), "k int, line string")
    got = {}
    for r in Words.tokenize(df).orderBy("k", "word_no").collect():
        got.setdefault(r.k, []).append(r.word)
    assert got == {
        0: ["dont", "go", "2", "kettles"], 1: ["u.s.a", "rocks"], 2: ["well", "known", "snake_case"],
        4: [None], 5: ["1,000.5", "a", "1", "it’s"],
    }


def test_stop_words_keep_null_words(spark):
    words = table(spark, [("a",), ("b",), (None,)], "word string")
    stop = dims.literal_table(spark, [("a",), ("a",), ("zz",)], dims.STOP_WORDS)
    assert rows(Words.without_stop_words(words, stop), "word") == [("b",), (None,)]


@pytest.fixture(scope="module")
def talk(spark):
    """Random talk of two main speakers and a guest over a small vocabulary."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["good", "bad", "odd", "the"]
    made = []
    for e in range(6):
        for n in range(1, 41):
            who = rng.choice(["mia", "mia", "tom", "guest"])
            text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))
            made.append((f"0{1 + e % 2}0{e}", f"0{1 + e % 2}", n, who, text, rng.choice(["person"] * 5 + ["action"])))
    return made


MAIN = ["mia", "tom"]
SCORE = [("good", 3), ("bad", -2), ("the", 5), ("unused", 1)]
POLARITY = [("good", "positive"), ("bad", "negative"), ("odd", "positive"), ("odd", "negative")]
STOP = [("the",), ("the",), ("absent",)]


def spoken_lines(talk):
    """(person, running number, id, season, words) by brute force."""
    count = {}
    for id_, season, n, who, text, kind in sorted(talk, key=lambda r: (r[0], r[2])):
        if who in MAIN and kind == "person":
            count[who] = count.get(who, 0) + 1
            yield who, count[who], id_, season, text.split()


def test_sentiment(spark, talk):
    lines, stop = table(spark, talk, LINES), dims.literal_table(spark, STOP, dims.STOP_WORDS)
    scored = dims.literal_table(spark, SCORE, dims.LEX_SCORE)
    hits = S.lexicon_hits(lines, MAIN, stop, scored, bucket_lines=5, ranges=7)
    score, ends = {}, {}
    for who, n, _, season, words in spoken_lines(talk):
        for w in words:
            if w in ("good", "bad"):
                score[who, n // 5] = score.get((who, n // 5), 0) + dict(SCORE)[w]
                ends[season, who] = max(ends.get((season, who), 0), n // 5)
    assert rows(S.score_by_bucket(hits), "person", "bucket", "sum_score") == sorted(((*k, v) for k, v in score.items()), key=str)
    assert rows(S.season_bucket_end(hits), "season", "person", "bucket") == sorted(((*k, v) for k, v in ends.items()), key=str)

    polar = S.lexicon_hits(lines, MAIN, stop, dims.literal_table(spark, POLARITY, dims.LEX_SENTIMENT), 5, 7)
    sides = {}
    for who, n, id_, _, words in spoken_lines(talk):
        for w in words:
            for word, side in POLARITY:
                if w == word:
                    key = (who, id_, n // 5)
                    sides.setdefault(key, {}).setdefault(side, 0)
                    sides[key][side] += 1
    expected = []
    for key, s in sides.items():
        p, n = s.get("positive"), s.get("negative")
        both = p is not None and n is not None
        expected.append((*key, n, p, p / n if both else None, p - n if both else None))
    got = rows(S.polarity_by_bucket(polar), "person", "id", "bucket", "negative", "positive", "ratio", "diff")
    assert got == sorted(expected, key=str)
    assert any(r[5] is None for r in got)
    assert S.emotion_by_bucket(polar).agg(F.sum("n")).first()[0] == sum(v for s in sides.values() for v in s.values())


def test_recon_and_sums(spark, talk):
    lines = table(spark, talk, LINES)
    spoken = Words.spoken_by_main(lines, MAIN)
    words = Words.tokenize(spoken)
    empty = sum(1 for *_, w in spoken_lines(talk) if not w)
    recon = M.token_line_recon(spoken, words).na.fill(0)
    assert recon.agg(F.sum("n_lines") - F.sum("n_token_lines")).first()[0] == empty > 0
    total = words.count()
    assert M.count_by(words, "person").agg(F.sum("n")).first()[0] == total
    sets = {(r.person, r.season, r.level): r.n for r in M.words_grouping_sets(words).collect()}
    assert sum(n for (p, s, level), n in sets.items() if level == 1) == total
    assert {level for *_, level in sets} == {0, 1, 2}


def brute_weights(talk, stop):
    count, lines = {}, {}
    for who, _, _, _, words in spoken_lines(talk):
        for w in words:
            count[who, w] = count.get((who, w), 0) + 1
    own = {p: sum(n for (q, w), n in count.items() if q == p and w not in stop) for p in MAIN}
    everyone = sum(own.values())
    return {
        (p, w): n * n / sum(m for (_, v), m in count.items() if v == w) * (everyone / own[p])
        for (p, w), n in count.items() if w not in stop
    }


@pytest.mark.parametrize("top", [1, 3, 30])
def test_distinctive_words(spark, talk, top):
    lines = table(spark, talk, LINES)
    words = Words.tokenize(Words.spoken_by_main(lines, MAIN))
    stop = dims.literal_table(spark, STOP, dims.STOP_WORDS)
    got = D.distinctive_words(words, lines, stop, MAIN, ["w3"], top)
    weights = brute_weights(talk, {"the"})
    best = {k: v for k, v in weights.items() if v == max(x for (_, w), x in weights.items() if w == k[1]) and k[1] != "w3"}
    expected = set()
    for p in MAIN:
        mine = {w: v for (q, w), v in best.items() if q == p}
        expected |= {(p, w) for w, v in mine.items() if sum(x > v for x in mine.values()) < top}
    found = {(r.person, r.word): r.unique for r in got.collect()}
    assert set(found) == expected
    assert all(math.isclose(found[k], weights[k]) for k in found)
    order = D.ranked_words(got).orderBy("order").collect()
    assert [r.order for r in order] == list(range(1, len(expected) + 1))
    assert [(r.person, r.person_word) for r in order] == sorted((r.person, r.person_word) for r in order)


def test_ties_are_kept(spark):
    """Two speakers tie on a word, and more words than wanted tie on a weight."""
    lines = table(spark, [("1", "s", i, p, "x y z", "person") for i, p in enumerate(MAIN)], LINES)
    words = Words.tokenize(lines)
    stop = dims.literal_table(spark, [("q",)], dims.STOP_WORDS)
    got = D.distinctive_words(words, lines, stop, MAIN, [], top=1)
    assert rows(got, "person", "word") == sorted(((p, w) for p in MAIN for w in "xyz"), key=str)


def test_cooccurrence(spark):
    rng = random.Random(3)
    people = [f"p{i:02d}" for i in range(70)]  # more than one mask holds
    scenes = [rng.sample(people[:-1], rng.randint(1, 5)) for _ in range(60)]
    made = [(str(s % 4), s, p) for s, cast in enumerate(scenes) for p in cast for _ in range(rng.randint(1, 3))]
    df = table(spark, made + [("9", 1, "stranger")], "id string, scene long, person string")
    got = {(r.person_a, r.person_b): r.n for r in pairs.cooccurrence(df, people).collect()}
    present = sorted({p for c in scenes for p in c})
    assert got == {(b, a): sum(a in c and b in c for c in scenes) for a, b in combinations(present, 2)}
    assert 0 in got.values() and not any("p69" in k for k in got)
    matrix = pairs.presence_matrix(df, people).collect()
    assert sum(r[p] for r in matrix for p in people) == sum(len(c) for c in scenes)


def test_cooccurrence_of_nobody(spark):
    df = table(spark, [("1", 1, "x")], "id string, scene long, person string")
    assert pairs.cooccurrence(df, MAIN).count() == 0


def test_pay(spark):
    lines = table(spark, [("1", "01", 1, "mia", "a b c", "person"), ("1", "01", 2, "mia", "d", "action"),
                          ("2", "02", 1, "mia", "e", "person"), ("2", "02", 2, "tom", "f g", "person"),
                          ("2", "02", 3, "guest", "h", "person")], LINES)
    words = Words.tokenize(Words.spoken_by_main(lines, MAIN))
    pay = dims.literal_table(spark, [("01", 10.0, 20.0, 2.0), ("02", 5.0, 6.0, 1.0), ("03", 1.0, 1.0, 3.0)], dims.PAY)
    names = dims.literal_table(spark, [("mia", "actor (mia)")], dims.DISPLAY_NAMES)
    t = P.pay_table(lines, words, pay, MAIN)
    assert rows(t, "person", "season", "num_lines", "total_lines", "total_lines_person", "num_words", "total_salary_adj") == [
        ("mia", "01", 2, 4, 3, 3, 49.0), ("mia", "02", 1, 4, 3, 1, 49.0), ("tom", "02", 1, 4, 1, 2, 49.0),
        (None, "03", None, None, None, None, 49.0),
    ]
    assert rows(P.pay_per_season(t, names), "person", "season", "pay_per_word_per_season") == [
        ("actor (mia)", "01", 40 / 3), ("actor (mia)", "02", 6.0), ("tom", "02", 3.0), (None, "03", None),
    ]
    long = rows(P.pay_overall_long(t, names), "person", "stat", "overall_pay")
    assert ("tom", "USD Per Line", 49.0) in long and ("actor (mia)", "USD Per Word", 12.25) in long and len(long) == 6
    assert rows(table(spark, [(1234.5,)], "x double").select(P.money(F.col("x"), 2).alias("m")), "m") == [("$1,234.50",)]
    assert V.vocab_normalised(words, pay).filter("person = 'mia' and season = '01'").first().total_nchar_norm == 1.5


def test_default_pay_table(spark):
    totals = P.salary_totals(dims.literal_table(spark, K.PAY, dims.PAY))
    assert totals.agg(F.sum("n_groups")).first()[0] == 236
    assert totals.select("total_salary").distinct().collect()[0][0] == sum(p * n for _, p, _, n in K.PAY)


def test_vocabulary(spark):
    words = table(spark, [("mia", "01", "e1", w) for w in ["aa", "aa", "bbbb"]] + [("tom", "01", "e1", "c")],
                  "person string, season string, id string, word string")
    assert rows(V.vocab_distinct_length(words), "person", "n", "avg_char", "stdev_char") == [
        ("mia", 2, 3.0, math.sqrt(2)), ("tom", 1, 1.0, None)]
    assert rows(V.vocab_episode_length(words), "person", "n", "avg_char") == [("mia", 3, 8 / 3), ("tom", 1, 1.0)]


def test_trend(spark):
    rng = random.Random(1)
    points = [(p, x, rng.uniform(-5, 5)) for p in MAIN for x in rng.sample(range(60), 40) for _ in range(rng.randint(1, 2))]
    points += [("lone", 7, 2.0), ("lone", 70, 4.0)]
    h = 6
    got = {(r.person, r.x): r.trend for r in trend_smooth(table(spark, points, "person string, x long, y double"), ["person"], "x", "y", h).collect()}
    assert set(got) == {(p, x) for p, x, _ in points}
    for (p, x), value in got.items():
        near = [(b - x, y, (1 - (abs(b - x) / h) ** 3) ** 3) for q, b, y in points if q == p and abs(b - x) < h]
        s0, s1, s2 = (sum(w * d**k for d, _, w in near) for k in range(3))
        t0, t1 = (sum(w * y * d**k for d, y, w in near) for k in range(2))
        det = s0 * s2 - s1 * s1
        assert math.isclose(value, (s2 * t0 - s1 * t1) / det if det > 1e-9 else t0 / s0, rel_tol=1e-6, abs_tol=1e-9)


def test_speakers(spark):
    counts = {"a": 9, "b": 7, "c": 7, "d": 3, "e": 1, "f": 1}
    made = [("1", "01", i, p, "x", "person") for p, n in counts.items() for i in range(n)] + [("1", "01", 99, "z", "x", None)]
    totals = M.speaker_totals(table(spark, made, LINES))
    assert rows(totals, "person", "total_lines_person", "total_lines") == sorted(((p, n, 28) for p, n in counts.items()), key=str)
    assert [r.person for r in M.top_speakers(totals, 2).collect()] == ["a", "b", "c"]
    # quantile 0.5 of 9 7 7 3 1 1 is 5
    assert rows(M.main_vs_recurring(totals, ["a"], 0.5), "is_main", "line_total_group") == [("main", 9), ("recurr", 14)]


def test_lines_per_scene_and_checks(spark):
    made = [("1", 1, "mia", "person"), ("1", 1, "mia", "person"), ("1", 2, "tom", "scene"), ("1", 2, "x", None), ("2-3", 0, "mia", "action")]
    df = table(spark, made, "id string, scene long, person string, type string").withColumn("season", F.lit("01"))
    assert rows(M.lines_per_scene(df, MAIN), "id", "n_scenes", "avg_lines") == [("1", 2, 1.5), ("2-3", 1, 1.0)]
    assert rows(M.scenes_per_episode(df), "id", "max_scene") == [("1", 1), ("2-3", 0)]
    assert M.avg_scenes(df).first()[0] == 0.5 and M.total_scenes(df).first()[0] == 1
    assert rows(M.two_part_ids(df), "season", "id") == [("01", "2-3")]
    assert M.untyped_lines(df).count() == 1 and M.episode_count(df).first()[0] == 2
    assert rows(M.lines_by_person(df, MAIN), "person", "n", "label") == [("mia", 3, "3"), ("tom", 1, "1")]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_lines_on_storage(spark, tmp_path, format):
    made = [("0101", 'A "quoted"\ntitle, x', 1, "mia", "hi, \\ there", "person", "01", 0, "f.html"),
            ("0101", "t", 2, "(x)", None, None, "01", 1, "f.html"),
            ("1001", "t", 1, "tom", "", "person", "10", 0, "g.html")]
    schema = "id string, title string, line_no long, person string, line string, type string, season string, scene long, source_file string"
    path = str(tmp_path / "lines")
    write_lines(table(spark, made, schema), path, format)
    back = read_lines(spark, path, format)
    made[2] = (*made[2][:4], None, *made[2][5:])
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(made, key=str)


def test_lexicons_from_files(spark, tmp_path):
    """Parquet and CSV with a header give the same lexicon."""
    scored = dims.literal_table(spark, SCORE, dims.LEX_SCORE)
    scored.write.parquet(str(tmp_path / "p"))
    scored.write.option("header", True).csv(str(tmp_path / "c"))
    for path, kind in (("p", "parquet"), ("c", "csv")):
        got = dims.read_lexicon(spark, str(tmp_path / path), dims.LEX_SCORE, kind)
        assert sorted((r.word, r.score) for r in got.collect()) == sorted(SCORE)
