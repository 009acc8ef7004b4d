"""The named queries without SQL, over a whole small table: columns, types and rows by brute force."""

import re
import zlib

import public_tokenizers
import pytest

from scriptweave.llm import linededup, tokenfiles
from scriptweave.llm.queries import QUERIES, TOKENIZER
from tests.llm.test_llm import WORD, linked, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    """doc_id -> (text, source) of the given documents."""
    return {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, schema):
    """The rows of a query whose first columns are these."""
    df = QUERIES[name](spark, SF)
    wanted = [tuple(c.split(":")) for c in schema.split()]
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][: len(wanted)] == wanted
    return df.collect()


def test_op1(spark, given):
    rows = run(
        spark, "op1_quality",
        "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    )
    assert {r.doc_id for r in rows} == set(given) and len(rows) == len(given)
    for r in rows:
        text = given[r.doc_id][0] or ""
        words = WORD.findall(text)
        places = {}
        for k in range(len(words) - 4):
            places.setdefault(tuple(words[k : k + 5]), []).append(k)
        again = len({k + j for v in places.values() if len(v) > 1 for k in v for j in range(5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), again)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(words) < 10 or 100 * again > 20 * len(words)) and not (r.base_failed and r.kept)


def test_op2(spark, given):
    rows = run(spark, "op2_setsketch", "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean")
    sets = {i: shingles(t, 3) for i, (t, _) in given.items()}
    component = linked(sets, 85)
    assert sorted(tuple(r) for r in rows) == sorted((i, len(s), component[i], component[i] == i) for i, s in sets.items())


def test_op3(spark, given):
    rows = run(
        spark, "op3_kd_shards",
        "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    )
    raw = {i: (t or "").encode() for i, (t, _) in given.items()}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((i, len(b) + 8, zlib.crc32(b)) for i, b in raw.items())
    slots = {}
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        slots.setdefault(r.shard, []).append((r.slot, r["size"]))
    assert all(sorted(s for s, _ in found) == list(range(len(found))) for found in slots.values())
    totals = [sum(n for _, n in found) for found in slots.values()]
    # no cut can be nearer than a document
    assert max(totals) - min(totals) <= 2 * max(len(b) + 8 for b in raw.values())


def test_op5(spark, given):
    rows = run(spark, "op5_line_dedup", "doc_id:bigint text:string n_lines:bigint n_dropped:bigint")
    sets = {}
    for i, (text, _) in given.items():
        for k, line in enumerate((text or "").split("\n")):
            data = re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ").encode()
            if len(data) >= linededup.MIN_BYTES:
                sets[i, k] = frozenset(data[j : j + linededup.SHINGLE] for j in range(len(data) - linededup.SHINGLE + 1))
    component = linked(sets, linededup.PERCENT)
    expected = {place for place, first in component.items() if place != first}
    n_dropped = 0
    for r in rows:
        lines = (given[r.doc_id][0] or "").split("\n")
        wanted = [x for k, x in enumerate(lines) if (r.doc_id, k) not in expected]
        left = (r.text or "").split("\n") if r.n_dropped < r.n_lines else []
        assert r.n_lines - r.n_dropped == len(left) >= len(wanted) and not set(wanted) - set(left)
        n_dropped += r.n_dropped
    assert len(rows) == len(given) and n_dropped >= 0.99 * len(expected)


def test_op7(spark, given):
    rows = run(spark, "op7_toxicity", "doc_id:bigint held_out:boolean score:double predicted:int")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == set(given) and len(rows) == len(given)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and labels.get(r.doc_id) is not None:
            right.append(r.predicted == labels[r.doc_id])
    assert sum(right) >= 0.9 * len(right)


def test_op8(spark):
    rows = run(spark, "op8_main_text", "page_id:bigint url:string text:string n_chars:bigint")
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted((r.page_id, r.url) for r in rows) == sorted((i, p.url) for i, p in pages.items())
    for r in rows:
        assert r.n_chars == len(r.text) and all(x == " ".join(x.split()) and x for x in r.text.split("\n") if r.text)


def test_op9(spark, given):
    from tokenizers import Tokenizer

    rows = run(spark, "op9_token_files", "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint")
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), 0, []
    for i in sorted(given):
        ids = [*tokenizer.encode(given[i][0] or "", add_special_tokens=False).ids, tokenfiles.END_ID]
        expected.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in rows) == expected


def test_op10(spark, given):
    rows = run(spark, "op10_mixing", "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint")
    sizes, totals, taken, target = {i: len(WORD.findall(t or "")) for i, (t, _) in given.items()}, {}, {}, {}
    for i, (_, source) in given.items():
        totals[source] = totals.get(source, 0) + sizes[i]
    for r in rows:
        source = given[r.doc_id][1]
        assert (r["size"], r.source_size) == (sizes[r.doc_id], totals[source]) and r.taken <= 3 * r["size"]
        assert r.taken == 0 or r.taken % r["size"] == 0
        taken[source] = taken.get(source, 0) + r.taken
        assert target.setdefault(source, r.target) == r.target <= 3 * totals[source] + 1e-6
    assert len(rows) == len(given) and abs(sum(target.values()) - sum(totals.values())) < 1e-6 * sum(totals.values())
    longest = {s: max(sizes[i] for i, (_, x) in given.items() if x == s) for s in totals}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in totals)
