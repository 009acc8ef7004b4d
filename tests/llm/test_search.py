"""Exact repeats, ranked search and collocations against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and further columns under clashing names."""

import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from scriptweave.llm import collocations, ranked, repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- exact repeats ------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if times[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [[m.start(), m.end()] for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((len(x), sum(gone), len(spans), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [1, 5, 13, 14, 40, 146, 200])
def test_repeats(spark, monkeypatch, length):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 900)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(repeats, "_AT_ONCE", 512)
    rng = random.Random(length)

    def prose(n):
        return "".join(rng.choice("abé ") for _ in range(n))

    shared = [prose(3 * length + 50) for _ in range(3)]
    texts = [None, "", "x", shared[0], shared[0], "a" * (5 * length), shared[1] + "z" + shared[1], prose(4000)]
    for _ in range(25):
        text = prose(rng.randint(0, 3 * length))
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(shared)
            at = rng.randint(0, len(source) // 2)
            text += source[at : at + rng.randint(length // 2, 3 * length)] + prose(rng.randint(0, length))
        texts.append(text)
    for _ in range(6):
        changed = list(shared[2])
        changed[rng.randrange(len(changed))] = "Q"
        texts.append("".join(changed))
    rows = [(i, t, "s", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, _0 int").repartition(3)
    found = {r.doc_id: r for r in repeats.without_repeats(docs, length).collect()}
    for i, expected in enumerate(brute_repeats(texts, length)):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.spans, bytes(r.kept)) == expected and r["_0"] == 7
    assert len(found) == len(texts)


def test_repeats_shared_ids(spark):
    same = "".join(chr(97 + i * i % 26) for i in range(300))
    docs = spark.createDataFrame([(None, same), (None, "b" * 100), (1, same), (1, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.without_repeats(docs).collect()) == [(0, 0), (100, 0), (300, 300), (300, 300)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [1, 14, 146, 200])
def test_cover(length):
    cover = repeats.Cover.of(length)
    members = {m % cover.period for m in cover.members}
    for i in range(cover.period):
        for j in range(cover.period):
            assert any((i + d) % cover.period in members and (j + d) % cover.period in members for d in range(cover.period))


# -- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranked(docs, items, top):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, all_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in TERM.findall((text or "").translate(LOWER)) if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize("block, terms", [(8192, 1 << 20), (7, 40)])
def test_ranked(spark, monkeypatch, block, terms):
    monkeypatch.setattr(ranked, "BLOCK_DOCUMENTS", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)] + ["Été", "x-y", "A1"]

    def prose(n):
        return rng.choice([" ", ", ", "\n"]).join(words[min(int(rng.expovariate(0.06)), len(words) - 1)] for _ in range(n))

    docs = [(i, prose(rng.randint(1, 60))) for i in range(150)] + [(150, None), (151, ""), (152, "...")]
    docs += [(200 + i, "w1 w2 w70") for i in range(40)] + [(7, "w3 w70"), (None, "w1 w2 w70"), (300, prose(20_000))]
    items = [(i, prose(rng.randint(1, 12))) for i in range(12)] + [(12, None), (13, "w70 w70 w1"), (13, "zzz"), (None, "w70"), (14, " ".join(words))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id int, text string")
    found = sorted(map(str, map(tuple, ranked.ranked(d, b, top=6, block_terms=terms).collect())))
    assert found == sorted(map(str, brute_ranked(docs, items, 6)))
    assert ranked.ranked(d.limit(0), b).count() == 0 and ranked.ranked(d, b.limit(0)).count() == 0


def test_masks_stop_early():
    """Few of many documents are scored, and the best are right."""
    rng = random.Random(2)
    n = 4000
    doc = [sorted(rng.sample(range(n), size)) for size in (3000, 1500, 60)]
    share = [[rng.randint(900, 1000) for _ in x] for x in doc]
    import numpy as np

    block = ranked.Block(
        np.arange(n), np.zeros(n, dtype=bool), np.concatenate(doc).astype(np.int32), np.concatenate(share).astype(np.int64),
        np.cumsum([0] + [len(x) for x in doc]),
    )
    best = ranked.Best(20)
    scored = ranked.search(block, np.arange(3), np.array([1, 2, 50]), best)
    total = Counter()
    for value, places, shares in zip((1, 2, 50), doc, share):
        for i, s in zip(places, shares):
            total[i] += value * s
    expected = sorted((-s, i) for i, s in total.items())[:20]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == expected and scored < 200


# -- collocations -------------------------------------------------------------------------


def brute_collocations(docs, top, least, percent=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in candidates.items():
        inside = any(
            l == lang and len(w) > len(words) and 100 * b >= percent * a
            and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))
            for (l, w), b in candidates.items()
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    rows = []
    for lang in {r[0] for r in out}:
        for rank, (_, score, a, phrase, l, r, total) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return sorted(rows)


@pytest.mark.parametrize("slice_bytes, bits", [(8 << 20, 1 << 28), (300, 1 << 28), (300, 1)])
def test_collocations(spark, monkeypatch, slice_bytes, bits):
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(collocations, "TABLE_BITS", bits)
    rng = random.Random(9)
    words = ["a", "B", "é", "the", "of", "x'y", "10", "zz"]
    fixed = ["in spite of the", "New York City", "a b a b a", "of the"]

    def prose(n):
        return "".join(rng.choice([*words, *fixed]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(n))

    docs = [(rng.choice(["en", "de", None, "und"]), prose(rng.randint(0, 60))) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("fr", " .,"), ("fr", "one"), ("en", "a b " * 300), (None, "rain rain " * 30)] + [docs[0]] * 3
    d = spark.createDataFrame([(*r, 1) for r in docs], "lang string, text string, n int").repartition(4)
    found = collocations.collocations(d, top=15, least=6)
    assert sorted(map(tuple, found.collect())) == brute_collocations(docs, 15, 6)
    assert collocations.collocations(d.limit(0)).count() == 0


def test_collocations_rare_words(spark, monkeypatch):
    """Words too rare for any phrase count for their language's total; a frequent one stands beside them as well."""
    monkeypatch.setattr(collocations, "SLICE_BYTES", 400)
    rng = random.Random(3)
    docs = [
        (rng.choice(["en", "de", None]), " ".join(rng.choice([f"W{rng.randint(0, 9999)}", "of the", "OF", "é", "rain, rain"]) for _ in range(40)))
        for _ in range(30)
    ]
    docs += [("fr", "seul")] * 2
    d = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(d, top=15, least=8).collect())) == brute_collocations(docs, 15, 8)
    # and no windows of their own
    rows = d.selectExpr("coalesce(lang, 'und') AS lang", "xxhash64(coalesce(lang, 'und')) AS salt", "text")
    windows = collocations._windows(rows, collocations.Table(collocations._frequent(rows, 8)), 5)
    assert windows.filter("size = 1 AND w1 RLIKE 'w[0-9]+'").count() < 100 < windows.agg({"n": "sum"}).first()[0]


def test_collocations_memory():
    """A slice of words takes a few times its bytes, whatever finding them takes."""
    rng = np.random.default_rng(4)
    size = 8 << 20
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, len(words), 2000)]) for _ in range(size // 11000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "salt": [1] * len(texts), "text": texts})
    rows = SimpleNamespace(mapInArrow=lambda function, schema: function)
    few = SimpleNamespace(passes=lambda hashes: hashes % np.uint64(4) == 0)
    counted = collocations._windows(rows, few, 5)
    tracemalloc.start()
    try:
        n = sum(sum(b.column("n").to_pylist()) for b in counted(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 * len(texts)
    assert most < 12 * size


def test_exact_scores(spark):
    """Products beyond 64 bits."""
    found = spark.createDataFrame([(10**15, 10**13)], "a long, n long").selectExpr(
        "(1000 * CAST(a AS DECIMAL(38, 0)) * CAST(n AS DECIMAL(38, 0))) div (CAST(a AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0))) AS score"
    )
    assert found.first().score == 10


# -- lines and documents whose ids are no keys --------------------------------------------


@pytest.mark.parametrize("turn", [1, -1])
def test_lines_of_shared_ids(spark, turn):
    from scriptweave.llm import linededup

    a, b, c, d, e = (f"the {w} line of this text is long enough to be compared {w * 3}" for w in ("first", "other", "third", "fourth", "fifth"))
    rows = [(0, a, 1), (1, f"{a}\n{b}", 2), (1, f"{c}\n{d}", 3), (None, a, 4), (None, e, 5), (2, None, 6), (2, "", 7), (3, "ab\nab", 8)]
    docs = spark.createDataFrame(rows[::turn], "doc_id long, text string, n_lines int").repartition(3)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.deduplicated(docs).collect())
    assert got == Counter([
        (0, a, 1, 0), (1, b, 2, 1), (1, f"{c}\n{d}", 2, 0), (None, "", 1, 1), (None, e, 1, 0), (2, None, 0, 0), (2, "", 1, 0), (3, "ab\nab", 2, 0)
    ])
    short = linededup.deduplicated(docs.filter("doc_id = 3"), min_bytes=0).first()
    assert (short.text, short.n_dropped) == ("ab", 1)


@pytest.mark.parametrize("turn", [1, -1])
def test_documents_of_shared_ids(spark, turn):
    import corpus_pipeline as P
    from scriptweave.llm import setsketch

    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    x, y = (" ".join(rng.choice(words) for _ in range(120)) for _ in range(2))
    near_y = y + " end"
    rows = [(1, x), (1, y), (2, near_y), (3, "alone"), (3, "alone"), (None, x), (4, None), (4, "")]
    docs = spark.createDataFrame(rows[::turn], "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in setsketch.near_documents(docs).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (None, 1), (4, 4), (4, 4)])
    kept = dict(P.STAGES)["near_dedup"](spark, docs, "")
    assert Counter(map(tuple, kept.collect())) == Counter([(1, x), (1, y), (3, "alone"), (None, x), (4, None), (4, "")])


def test_words_of_one_base(spark):
    """Words whose letters follow the Thue-Morse sequence, and their complements."""
    import numpy as np
    import pyarrow as pa

    from scriptweave.llm import bytewords

    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (64, 1024, 2048, 4096):
        texts = next(bytewords.slices(pa.array([word[:n], word[:n].translate(str.maketrans("ab", "ba"))])))
        assert len(np.unique(bytewords.word_hashes(texts, bytewords.words(texts)))) == 2


@pytest.mark.parametrize("size", range(1, 7))
def test_runs_of_few_words(size):
    import itertools

    import pyarrow as pa

    from scriptweave.llm import bytewords

    for counts in itertools.product(range(7), repeat=2):
        texts = next(bytewords.slices(pa.array([" ".join("abcdefg"[:n]) for n in counts])))
        w = bytewords.words(texts)
        runs, first = bytewords.shingle_hashes(bytewords.word_hashes(texts, w), w, size)
        assert len(runs) == len(first) == sum(max(1, n - size + 1) for n in counts if n)


# -- what line deduplication writes -------------------------------------------------------


def test_lines_written_once(spark):
    """Near copies of long lines: what is kept on storage stays below twice the texts, as neither lines nor sets are."""
    from pathlib import Path

    from scriptweave.llm import linededup
    from scriptweave.operators.durable import shared_folder

    def held():
        folder = Path(shared_folder(spark).removeprefix("file:"))
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 "
    base = ["".join(rng.choice(letters) for _ in range(3000)) for _ in range(150)]
    near = [x[:1000] + "-" + x[1001:2000] + "-" + x[2001:] for x in base]
    docs = [(i, f"{a}\n{b}\nshort") for i, (a, b) in enumerate(zip(base, near))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    before = held()
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.deduplicated(df).collect()}
    assert got == {i: (f"{a}\nshort", 1) for i, a in enumerate(base)}
    assert held() - before < 2 * sum(len(t) for _, t in docs)


def test_lines_normalised():
    """Lines by arrays are lines by patterns, with their numbers and their bytes as they were."""
    import numpy as np

    from scriptweave.llm import bytewords, linededup

    rng = random.Random(6)
    texts = ["", "\n", "  \n\t\n", " a \r\n b", "a\n\n", *("".join(rng.choice("ab \t\r\n\x0b\x0cé") for _ in range(60)) for _ in range(300))]
    raw = [(t + "\n").encode() for t in texts]
    data, starts, ends, lengths, first = linededup.normalised(
        bytewords.Texts(0, np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    )
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    lines = [x for t in texts for x in t.split("\n")]
    assert got == [re.sub(r"[ \t\x0B\f\r]+", " ", x).strip(" ") for x in lines]
    assert lengths.tolist() == [len(x.encode()) for x in lines]
    assert np.diff(first).tolist() == [t.count("\n") + 1 for t in texts]


@pytest.mark.parametrize("size", [30, 150, 2000])
def test_line_signatures(size):
    """Places of two signatures agree as often as the sets' likeness says, for short lines and long ones."""
    import numpy as np

    from scriptweave.llm import bytewords, linededup

    agree = []
    for i in range(60):
        codes = bytewords.mix(np.arange(size + size // 4, dtype=np.uint64) + np.uint64(1_000_000 * (i + 1)))
        both = np.concatenate([codes[:size], codes[:1], codes[size // 4 :]])
        a, b = linededup.signature(both, np.array([0, size + 1, len(both)]))
        agree.append((a == b).mean())
    shared, union = size - size // 4, size + size // 4
    assert abs(np.mean(agree) - shared / union) < 0.04


def test_small_buckets_have_all_pairs(spark):
    """Two that differ from the centre of their bucket and are alike, told by signatures; each line is signed once."""
    import numpy as np

    from scriptweave.llm import linededup, near

    same = [np.arange(60, dtype=np.uint8) for _ in range(5)]
    same[3][:40] = 200
    same[4][:40] = 200
    classes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(same)], "id long, registers binary")
    buckets = spark.createDataFrame([(b, i, 5) for b in (7, 8) for i in range(5)], "bucket long, id long, members long")
    got = {(r.a, r.b): r.star for r in near._judged(buckets, classes, linededup.possible, 80).collect()}
    assert got == {(0, 1): True, (0, 2): True, (1, 2): False, (3, 4): False}

    more = spark.createDataFrame([(2, 9), (11, 12), (9, 4)], "u long, v long")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    assert dict(near.joined(found, more).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 11: 11, 12: 11}
    assert near.joined(found, more.limit(0)).count() == 4

    line = "a line that is long enough to be compared and stands in the text again"
    rows = linededup.bucketed(spark.createDataFrame([(0, f"{line}\n{line}\nanother line, and none is like it"), (1, line)], "place long, text string").coalesce(1))
    signed = linededup._lines(rows, 20).collect()
    assert len(signed) == 4 and len({(r.hi, r.lo) for r in signed}) == 2
    assert 2 <= sum(r.registers is not None for r in signed) <= 3 and all(len(r.registers) == 60 for r in signed if r.registers)


# -- what the buckets of near duplicates hold besides near ones ----------------------------


def test_strangers_in_buckets_make_no_cluster(spark, monkeypatch):
    """Buckets that chain strangers together: they are told apart by signatures, not in blocks of all; two that are alike
    and no centre of their bucket, which may be large, are found."""
    import numpy as np

    from scriptweave.llm import bytewords, near, setsketch

    def codes(places):
        return np.sort(bytewords.mix(np.array(places, dtype=np.uint64)))

    # each shares half of its codes with the next
    sets = {i: codes(range(20 * i, 20 * i + 40)) for i in [*range(700), *range(2000, 2099)]}
    alike = {1000: range(100_000, 100_040), 1001: range(100_001, 100_041), 2099: [*range(41_960, 41_999), 7]}
    sets |= {i: codes(x) for i, x in alike.items()}
    rows = [(i, len(x), bytearray(setsketch.sketch(x, np.array([0, len(x)])).tobytes())) for i, x in sets.items()]
    classes = spark.createDataFrame(rows, "id long, n long, registers binary")
    stored = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in sets.items()], "id long, n long, codes binary")
    members = {b: [b, b + 1, b + 2] for b in range(698)} | {5000: [1, 1000, 1001], 6000: range(2000, 2100)}
    buckets = spark.createDataFrame([(b, i, len(x)) for b, x in members.items() for i in x], "bucket long, id long, members long")

    compared, block_links = [], near._block_links

    def counted(rows, *rest):
        compared.append(rows.count())
        return block_links(rows, *rest)

    monkeypatch.setattr(near, "_block_links", counted)
    found = near.bucket_components(
        buckets, classes, lambda wanted: stored.join(wanted.select("id").distinct(), "id", "left_semi"), near._stored, setsketch.possible, 85
    )
    assert dict(found.collect()) == {1000: 1000, 1001: 1000, 2098: 2098, 2099: 2098}
    assert sum(compared) <= 8


@pytest.mark.parametrize("size", [2, 7, 90])
def test_likely_groups(size):
    import numpy as np

    from scriptweave.llm import near

    def judge(a, b, na, nb, percent):
        return np.abs(a[:, 0].astype(int) - b[:, 0].astype(int)) <= 2

    rng = np.random.default_rng(size)
    for _ in range(40):
        n, component = rng.integers(5, 30, size), rng.integers(0, max(1, size // 2), size)
        registers = rng.integers(0, rng.integers(5, 255), (size, 1)).astype(np.uint8)
        root = {c: c for c in component.tolist()}
        for i in range(size):
            for j in range(size):
                if 100 * min(n[i], n[j]) >= 85 * max(n[i], n[j]) and abs(int(registers[i, 0]) - int(registers[j, 0])) <= 2:
                    old, new = root[component[j]], root[component[i]]
                    root = {c: new if r == old else r for c, r in root.items()}
        wanted, groups = [root[c] for c in component.tolist()], near.likely_groups(component, n, registers, judge, 85).tolist()
        assert len(set(zip(wanted, groups))) == len(set(wanted)) == len(set(groups))


def test_likelihoods_in_two_rounds():
    """A coarse grid first: the verdicts are those of the whole grid."""
    import numpy as np

    from scriptweave.llm import setsketch

    rng = np.random.default_rng(3)
    a = rng.integers(20, 140, (4000, 160)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < rng.random((len(a), 1)), a, rng.integers(20, 140, a.shape)).astype(np.uint8)
    na = rng.integers(1, 2000, len(a))
    nb = np.maximum(1, (na * rng.uniform(0.5, 2, len(a))).astype(int))
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = na / (na + nb)
    wanted = np.minimum(0.85, np.minimum(u / (1 - u), (1 - u) / u))
    at, *others = (
        setsketch._log_likelihood(wanted * share, u, 1 - u, above, below, 160 - above - below) for share in [1, *np.linspace(0, 1, 41)[:-1]]
    )
    likely = np.maximum(at, np.max(others, axis=0)) - at <= setsketch.DOUBT
    got = setsketch.possible(a, b, na, nb, 85)
    assert (got == likely).all() and 0 < likely.sum() < len(a)
    assert len(setsketch.possible(a[:0], b[:0], na[:0], nb[:0], 85)) == 0
