"""The operators against brute force, on small tables with the odd cases: nulls, empty and long texts,
ties, repeated rows, empty tables, further columns under clashing names."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from scriptweave.llm import (
    components, decontamination, kdshards, licences, linededup, maintext, mixing, quality, setsketch, tokenfiles, toxicity,
)
from scriptweave.llm.labelled import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


WORDS = vocabulary(1)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [prose(rng, rng.randint(3, 120)) for _ in range(60)]
    base = prose(rng, 150)
    out += [base] * 5 + [edited(rng, base, k % 9) for k in range(80)]
    other = prose(rng, 90) + "\n" + prose(rng, 30)
    out += [other, other.upper(), other.replace("\n", " \t")] + [edited(rng, other, k) for k in range(6)]
    out += [None, "", " \n\t", "one", "one", "One two", "é ü ß", prose(rng, 30_000)]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def empty(documents):
    return documents.limit(0)


# -- near duplicates ---------------------------------------------------------------------


def shingles(text, n):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def linked(sets, percent):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i in keys}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_documents(documents, texts, n, percent):
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    expected = linked(sets, percent)
    got = setsketch.near_documents(documents, n, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), expected[i]) for i in sets}
    assert len(got) == len(texts) and len(set(expected.values())) < len(texts) - 40


def test_near_documents_odd(spark, documents):
    assert setsketch.near_documents(empty(documents)).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "z z z")]
    got = setsketch.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (9, 1, 9)], key=str
    )


def test_sketches_merge_and_estimate():
    import numpy as np

    from scriptweave.llm.bytewords import mix

    codes = np.sort(mix(np.arange(3000, dtype=np.uint64)))
    a, b = np.sort(codes[:2000]), np.sort(codes[500:])
    both = setsketch.sketch(codes, np.array([0, 3000]))
    parts = [setsketch.sketch(x, np.array([0, len(x)])) for x in (a, b)]
    assert (np.maximum(parts[0], parts[1]) == both).all()
    # 1,500 of 3,000 in common: neither ruled out at 50 nor possible at 85
    n = (np.array([2000]), np.array([2500]))
    assert setsketch.possible(*parts, *n, 50)[0] and not setsketch.possible(*parts, *n, 85)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 140)} == {100} and got[200] == 200
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(3)
    long = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(30)]
    docs = []
    for i in range(40):
        lines = [rng.choice(long) for _ in range(3)] + [prose(rng, 12), "short", ""]
        lines.append(edited(rng, rng.choice(long), 1))
        lines.append("  " + rng.choice(long).upper().replace(" ", "  "))
        docs.append((i, "\n".join(lines)))
    docs += [(40, None), (41, ""), (42, "\n\n"), (None, long[0])]
    flat = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            normal = re.sub(r"[ \t\x0B\f\r]+", " ", line.lower()).strip(" ").encode()
            if len(line.encode()) >= 20 and len(normal) >= 20:
                flat[(i is None, -1 if i is None else i, k)] = frozenset(normal[j : j + 8] for j in range(len(normal) - 7))
    first = linked({n: flat[n] for n in sorted(flat)}, linededup.PERCENT)
    expected = {}
    for i, text in docs:
        if text is not None:
            key = (i is None, -1 if i is None else i)
            keep = [x for k, x in enumerate(text.split("\n")) if first.get((*key, k), (*key, k)) == (*key, k)]
            expected[i] = "\n".join(keep)
    df = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, line_no string")
    got = linededup.deduplicated(df).collect()
    assert {r.doc_id: r.text for r in got} == {**expected, 40: None}
    assert sum(r.n_dropped for r in got) == sum(1 for k, v in first.items() if k != v) > 60
    assert linededup.deduplicated(df.limit(0)).count() == 0


# -- single documents --------------------------------------------------------------------


def test_quality_counts(documents, texts):
    got = {r.doc_id: r for r in quality.assessed(documents, None).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = WORD.findall(text)
        places = {}
        for k in range(len(words) - 4):
            places.setdefault(tuple(words[k : k + 5]), []).append(k)
        again = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words)) and r.kept != r.base_failed
    assert quality.assessed(empty(documents), None).count() == 0


def labelled(spark, mark, n=400):
    """Documents of which every third has a mark, and their labels; one label twice, some null."""
    rng = random.Random(11)
    docs = [(i, prose(rng, rng.randint(30, 80)) + (f" {mark()}" * 4 if i % 3 == 0 else "") + " end") for i in range(n)]
    labels = [(i, 0 if i % 3 == 0 else 1, 1 if i % 3 == 0 else 0) for i in range(n)] + [(0, 0, 1), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_model(spark):
    documents, labels = labelled(spark, lambda: "##|| $$")
    model = quality.fit(documents, labels)
    got = quality.assessed(documents, model).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    right = {fold: [r.kept == (r.doc_id % 3 != 0) for r in got if not r.base_failed and r.held_out == fold] for fold in (True, False)}
    assert all(right[False]) and len(right[True]) > 50 and sum(right[True]) >= 0.95 * len(right[True])
    assert quality.fit(documents, labels.limit(0)) is None


def test_toxicity(spark):
    rng = random.Random(5)
    suffixes = vocabulary(9, 40)
    documents, labels = labelled(spark, lambda: "bleurgh" + rng.choice(suffixes))
    learned = toxicity.learn(documents, labels.filter("doc_id % 5 <> 0"))
    got = toxicity.scored(documents, learned).collect()
    held_out = [r for r in got if r.doc_id % 5 == 0]
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in held_out)
    odd = [(None, None), (1, ""), (2, "bl3urgh bLЕurghx ｂleurgh y"), (3, "fine words only here")]
    scores = [r.score for r in toxicity.scored(spark.createDataFrame(odd, "doc_id long, text string"), learned).collect()]
    assert max(scores[0], scores[1], scores[3]) < 0.5 < scores[2]
    assert toxicity.scored(documents.limit(0), learned).count() == 0
    assert toxicity.scored(documents, toxicity.learn(documents, labels.limit(0))).agg(F.max("score")).first()[0] == 0


def test_toxicity_exceptions():
    lexicon = toxicity.Lexicon({"|rude|": 4.0, "|nast": 3.0}, {"rude awakening"}, (1.0, 0.0, -1.0))
    assert [x for _, x in lexicon.matches(toxicity.folded_words("a rude word, a rude awakening, nasty n4stier"))] == [4.0, 3.0, 3.0]
    assert lexicon.score("a rude word") > 0.5 > lexicon.score("a rude awakening")


def brute_hits(text, items, size=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = pattern.findall((text or "").translate(lower))
    hit, found = set(), set()
    for item, item_text in items:
        own = pattern.findall((item_text or "").translate(lower))
        for w in {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set():
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, texts, documents, block):
    rng = random.Random(2)
    short = [t for t in texts if t and len(t) < 2000]
    items = [(i, " ".join(rng.choice(short).split()[:15])) for i in range(12)]
    items += [(50, "one"), (51, None), (52, ""), (53, items[0][1].upper()), (54, "É ü ß")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.benchmark_hits(documents, benchmark, keep=["doc_id", "text"], block_chars=block)
    rows = rows.withColumn("digest", decontamination.items_digest()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (n, hit, len(found), found)
        assert r.digest == hashlib.sha256(",".join(found).encode()).hexdigest()
        # the spans are the hit words as written
        assert sum(brute_hits(r.text[a:b], [])[0] for a, b in r.spans) == hit
    assert decontamination.benchmark_hits(documents, benchmark.limit(0)).agg(F.max("n_hit")).first()[0] == 0
    assert decontamination.benchmark_hits(empty(documents), benchmark).count() == 0


MIT = licences.SENTENCES["mit-grant"] + "\n\n" + licences.SENTENCES["mit-condition"]
BSD = "\n".join(licences.SENTENCES[k] for k in ("bsd-redistribute", "bsd-source", "bsd-binary"))


def test_licences(spark):
    texts = [
        "words\nReleased under the MIT License.\nmore", MIT, BSD, BSD + " " + licences.SENTENCES["bsd-endorse"],
        licences.SENTENCES["bsd-source"] + " " + licences.SENTENCES["bsd-redistribute"], None, "", "A licence is a permission.",
        "x" * 100_000 + " licensed " + "y. " * 1000, "LICENSED under CC BY-NC 4.0.\nReleased under the MIT license",
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    got = {r.doc_id: r.licences for r in licences.scanned(df).collect()}
    assert [got[i] for i in range(len(texts))] == ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "", "", "", "", "", "CC-BY-NC-4.0,MIT"]
    assert licences.scanned(df.limit(0)).count() == 0


def test_licence_rules_find_themselves(spark, tmp_path):
    """Every known text and every rule, on one line and run over lines, and a rulebook of tables."""
    rules = [(licence, " ".join(licences.SENTENCES[key] for key in rule)) for licence, rule in licences.RULES]
    texts = [(f"{licence} {i} {t}", text) for i, (licence, x) in enumerate(rules) for t, text in enumerate((x, " ".join(x.split())))]
    # a text of which no rule begins has a word of one here
    texts += [(key, "Licensed. " + text) for key, text in licences.SENTENCES.items()]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    for r in licences.scanned(df).collect():
        name = r.doc_id.split(" ")[0]
        if name in licences.SENTENCES:
            known = licences.BUILT_IN.identifiers()
            assert {known[p] for p in licences.pieces(licences.SENTENCES[name])} == set(r.sentence_ids.split(","))
        else:
            assert r.licences == name
    notice = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not"
    gpl = " ".join(licences.SENTENCES[k] for k in ("gpl2-published", "gpl2-later"))
    df = spark.createDataFrame([(1, notice), (2, "This program is free software; " + gpl)], "doc_id long, text string")
    assert [r.licences for r in licences.scanned(df).orderBy("doc_id").collect()] == ["MPL-2.0", "GPL-2.0-or-later"]
    spark.createDataFrame([("a", "Use it. As you like!"), ("b", "But ask.")], "id string, text string").write.json(str(tmp_path / "s"))
    spark.createDataFrame([("Own", ["a", "b"])], "licence string, ids array<string>").write.json(str(tmp_path / "r"))
    book = licences.read_rulebook(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    df = spark.createDataFrame([(1, "Use it. As you like! But ask."), (2, "Use it. But ask.")], "doc_id long, text string")
    assert [r.licences for r in licences.scanned(df, rulebook=book).orderBy("doc_id").collect()] == ["Own", ""]


PAGE = """<!doctype html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>A &amp; B</h1><p><b>First   line<br>goes on.<p>Second&nbsp;one is rather longer than the first.</p>
<form><p>Your name here please</p></form><div class="comments"><p>Reader says something quite long here.</p></div></article>
<aside><p>Related things you may like to read.</p></aside><footer>&copy; all</footer></body></html>"""


def test_main_text(spark):
    pages = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "<p>" + "x" * 300_000), (5, "<nav>a</nav>"), (6, "plain < text of a page & more")]
    df = spark.createDataFrame([(i, h, "u") for i, h in pages], "page_id long, html string, text string")
    got = sorted((r.page_id, r[1], r[2]) for r in maintext.extracted(df, keep=["page_id"]).collect())
    text = "A & B\nFirst line goes on.\nSecond one is rather longer than the first."
    assert [x[1] for x in got[:4]] == [text, text, "", ""] and got[0][2] == len(text)
    assert got[4][2] == 300_000 and got[5][1] == ""
    assert maintext.extracted(df.limit(0)).count() == 0
    for opening in ("<script ", "<!-- ", "<p ", "<a ", "<div>", "<b class=\"", "&amp"):
        maintext.main_text(opening * 50_000)


STORY = "<p>The first paragraph of a story that is told here at some length.</p><p>The second one goes on with it.</p>"
TOLD = "The first paragraph of a story that is told here at some length.\nThe second one goes on with it."


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="has-sidebar"><nav>Home</nav><article>{STORY}</article></body>',
        f'<html class="menu"><body class="sidebar"><article>{STORY}</article></body></html>',
        f'<body><div class="content with-sidebar">{STORY}</div><div class="sidebar"><p>Other things</p></div></body>',
        f'<body><div class="no-menu">{STORY}</div></body>',
        f'<body><div class="header-wrap"><main>{STORY}</main></div><div class="ad">Buy</div></body>',
        f'<body><div class="post-login">{STORY}</div></body>',
        f'<body><article>{STORY}</article><div class="comments"><article><p>A reader says something as long as the story is, or even'
        " longer than that, which is no part of it at all.</p></article></div></body>",
    ]
    + [f"<article><{x} src='y'>{STORY}</article>" for x in ("video", "object", "svg", "audio", "canvas", "iframe")],
)
def test_main_text_names_and_open_elements(page):
    assert maintext.main_text(page) == TOLD


def test_main_text_parts():
    assert maintext.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p></article>") == "Let x=1 be so."
    steps = "<ul><li>Flour</li><li>Two eggs</li><li>Milk</li></ul>"
    told = maintext.main_text(f"<body><div>{STORY}{steps}{STORY}</div></body>")
    assert told == f"{TOLD}\nFlour\nTwo eggs\nMilk\n{TOLD}"
    for opening in ("<video>", '<div class="ad">', '<div class="ad"><article>'):
        maintext.main_text(opening * 50_000)


def test_minimum_cut():
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        terminal = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            own = sum(max(t, 0) if not s else max(-t, 0) for t, s in zip(terminal, side))
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(maintext.minimum_cut(terminal, edges)) - best) < 1e-9


# -- whole corpora -----------------------------------------------------------------------


def test_token_files(spark, documents, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["<|endoftext|> a", "a\x01b \x01", "ΑΣ, ς. İ.", "it's, we'll. 12,5. a.b ..", "WORD.\nword, word.", "漢字 🙂​ é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 - i, t) for i, t in enumerate(odd)] + [(3, "again"), (None, "none")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    out = str(tmp_path / "tokens")
    tokenfiles.write_tokens(df, out, path, partitions=4)
    read = tokenfiles.read_tokens(spark, out)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    expected = sorted(
        ((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, tokenfiles.END_ID]) for i, t in rows),
        key=lambda x: (x[0] is not None, x[0] or 0),
    )
    stored = [(r.doc_id, r.ids) for r in read.orderBy("part", "row").collect()]
    assert [i for i, _ in stored] == [i for i, _ in expected] and sorted(map(str, stored)) == sorted(map(str, expected))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.summaries(read).collect())
    start = 0
    for (doc, ids), r in zip(stored, got):
        assert r == (start, doc, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert read.filter("doc_id = 997").count() == 1
    tokenfiles.write_tokens(df.limit(0), str(tmp_path / "none"), path)
    assert tokenfiles.summaries(tokenfiles.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "ö", "z", None]), "k") for i in range(3000)]
    rows += [(5000, None, "q", "k"), (5001, "", "a", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mixed(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"}
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        rest = sum(weights[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weights[s] / rest for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(df.repartition(7)).collect()))
    assert mixing.repeated(df).columns == df.columns and mixing.repeated(df).agg(F.max("size")).first()[0] == "k"
    assert mixing.repeated(df).agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == sum(taken.values())
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 24])
def test_kd_shards(documents, texts, shards):
    rows = kdshards.kd_shards(documents, shards, rows_per_block=50).collect()
    sizes = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    assert {(r.doc_id, r[-3]) for r in rows} == set(sizes.items())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append((r.slot, r[-3]))
    assert set(by) <= set(range(shards))
    for found in by.values():
        assert sorted(s for s, _ in found) == list(range(len(found)))
    if shards == 1:
        assert kdshards.kd_shards(empty(documents), 24).count() == 0
        assert kdshards.kd_shards(documents.filter("n_chars = 2"), target_bytes=100).count() == 0


def test_kd_shards_are_even(spark):
    """A source with a third of all rows, and a thousand equal points."""
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(1, 400), "en", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(4000)]
    rows += [(10_000 + i, "same", "en", "hot") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = kdshards.kd_shards(df.withColumns({"shard": F.lit("x"), "Slot": F.lit("y")}), 5)
    assert clash.columns == ["doc_id", "text", "lang", "source", "size", "shard", "slot"] and clash.agg(F.max("shard")).first()[0] == 4
    sums = [r[1] for r in kdshards.kd_shards(df, 24).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) <= 2 * 408
    again = kdshards.kd_shards(df, target_bytes=sum(sums) / 24).agg(F.max("shard")).first()[0]
    assert again == 23
