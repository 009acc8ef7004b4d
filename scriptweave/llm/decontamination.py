"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

A text's normal form is its words: lower case a-z, digits and everything beyond ASCII; all else
separates. Every ten-word window of an item, or the whole item where it is shorter, is a pattern
over word numbers. Each text is scanned once, word by word; matches are runs of words, and those
are turned back into offsets in the text as it was.

One automaton holds up to ``BLOCK_CHARS`` of benchmark text. A larger benchmark has one for each such block;
hashes of all windows, looked up in one pass over the texts, tell which texts may meet which block, and a
block's automaton scans those alone. So most texts are read once, however large the benchmark.

Null or empty texts and items have no words and match nothing. Repeated items and windows are one
pattern each with all item ids. Rows of documents are kept as they are, repeated ones too; columns
besides the text are carried along untouched; a result replaces a column of its name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.durable import durable, new_path
from . import bytewords
from .memory import released

WINDOW = 10
# Benchmark text in one automaton, some 250 MB in memory.
BLOCK_CHARS = 1 << 20
# Window hashes looked up in one pass over the texts, 12 bytes each in every worker. A benchmark of more, some
# 50 MB of text, takes a pass for each so many.
INDEX_WINDOWS = 1 << 23
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def normal_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text's normal form."""
    return text.translate(_NORMAL).split() if text else []


def windows(words: list, size: int = WINDOW) -> list[tuple]:
    """All windows; the whole, where there are fewer words, but not none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Matcher:
    """The automaton of some (item id, text) rows, and the numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        ids: dict[tuple, set[str]] = {}
        self.numbers: dict[bytes, int] = {}
        for item, text in items:
            for window in windows(normal_words(text), size):
                for word in window:
                    self.numbers.setdefault(word, len(self.numbers) + 1)
                ids.setdefault(tuple(self.numbers[w] for w in window), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if ids else None
        for window, found in ids.items():
            self.machine.add_word(window, (len(window), tuple(sorted(found))))
        if self.machine is not None:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit runs of words (first, behind the last; merged, in order) and the item ids."""
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.machine is None or not words:
            return runs, items
        get = self.numbers.get
        for end, (n, found) in self.machine.iter(tuple([get(w, 0) for w in words])):
            first, last = end + 1 - n, end + 1
            items.update(found)
            while runs and first <= runs[-1][1]:
                first = min(first, runs.pop()[0])
            runs.append((first, last))
        return runs, items


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets (in characters) in the text of runs of words of its normal form."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWERED))]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str, bytes]], size: int) -> Matcher:
    """A block's automaton, built once per Python worker; only the latest is held."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, size)
    return _MATCHERS[key]


_RESULTS = {"n_words", "n_hit", "n_items", "items", "spans"}
_PAIRS = T.ArrayType(T.ArrayType(T.LongType()))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("runs", _PAIRS), T.StructField("spans", _PAIRS)]
_ARROW = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))]


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's rows, in blocks of bounded size."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.encode(text, "UTF-8"))
    block, held = [], 0
    for key, value in rows.filter(F.length(text) > 0).toLocalIterator():
        block.append((key, bytes(value)))
        held += len(value)
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    size: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Adds to each document n_words, n_hit (words in any window), n_items, items (their ids as
    strings, sorted) and spans (offsets [from, to) of the hit text).

    ``keep`` names the columns to carry (default: all). The texts are read once and nothing is
    shuffled. Beyond ``block_chars`` of benchmark text the rows are written once under numbers of their own,
    and what the blocks' automata find in a text, narrow rows, is put together by its number.
    """
    keep = documents.columns if keep is None else keep
    carried = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    rows = documents.select(F.col(f"`{text}`").alias("_text"), *carried)
    blocks = _blocks(benchmark, item, item_text, block_chars)
    block, following = next(blocks), next(blocks, None)
    found = _scan(rows, block, size) if following is None else _routed(rows, chain([block, following], blocks), size)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    names = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in _RESULTS]
    return found.select(*names, "n_words", "n_hit", "n_items", "items", "spans")


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], size: int) -> DataFrame:
    """What the automaton of the items finds, instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    @F.arrow_udf(T.StructType(_FOUND))
    def scanned(texts: pa.Array) -> pa.Array:
        matcher = _matcher(key, shared.value, size)
        out: list[list] = [[], [], [], []]
        for value in texts:
            words = normal_words(value.as_buffer().to_pybytes() if value.is_valid else None)
            runs, ids = matcher.scan(words)
            spans = offsets(value.as_py(), runs) if runs else []
            for column, found in zip(out, (len(words), sorted(ids), runs, spans)):
                column.append(found)
        return pa.StructArray.from_arrays([pa.array(v, type=kind) for v, kind in zip(out, _ARROW)], names=[f.name for f in _FOUND])

    # of a row only the text goes to Python; as if not deterministic, so that each row is scanned once
    kept = [F.col(c) for c in rows.columns if c != "_text"]
    found = rows.select(*kept, scanned.asNondeterministic()(F.col("_text")).alias("_found"))
    return found.select(*kept, *[F.col(f"_found.{f.name}") for f in _FOUND])


def _window_hashes(texts: bytewords.Texts, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the hashes of all windows of some texts and the text of each."""
    normal = bytewords.Texts(texts.first, np.frombuffer(_NORMAL, dtype=np.uint8)[texts.data], texts.bounds)
    words = bytewords.words(normal)
    hashes = bytewords.word_hashes(normal, words)
    for size in sizes:
        found, first = bytewords.shingle_hashes(hashes, words, size)
        yield found, words.text[first]


def _block_hashes(items: list[tuple[str, bytes]], size: int) -> tuple[np.ndarray, set[int]]:
    """The distinct hashes of a block's windows, and their sizes in words."""
    found = [np.zeros(0, dtype=np.uint64)]
    lengths = {min(size, len(normal_words(text))) for _, text in items} - {0}
    for texts in bytewords.slices(pa.array([text for _, text in items], type=pa.binary()).cast(pa.string())):
        found += [hashes for hashes, _ in _window_hashes(texts, [size])]
    return np.unique(np.concatenate(found)), lengths


def _groups(blocks: Iterator[list], size: int) -> Iterator[list[tuple[list, np.ndarray, set[int]]]]:
    """Blocks with their hashes, as many together as one index holds."""
    group, held = [], 0
    for items in blocks:
        hashes, lengths = _block_hashes(items, size)
        if group and held + len(hashes) > INDEX_WINDOWS:
            yield group
            group, held = [], 0
        group.append((items, hashes, lengths))
        held += len(hashes)
    yield group


def _candidates(rows: DataFrame, group: list[tuple[list, np.ndarray, set[int]]]) -> DataFrame:
    """(_block, _row, _text): the texts with a window's hash, once for each block that has it."""
    hashes = np.concatenate([h for _, h, _ in group])
    of = np.repeat(np.arange(len(group), dtype=np.int32), [len(h) for _, h, _ in group])
    order = np.argsort(hashes, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((hashes[order], of[order]))
    sizes = sorted(set().union(*[lengths for _, _, lengths in group]))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = shared.value
        for batch in released(batches):
            for texts in bytewords.slices(batch.column("_text")):
                pairs = [np.zeros((0, 2), dtype=np.int64)]
                for found, text in _window_hashes(texts, sizes):
                    low, high = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
                    some = np.flatnonzero(high > low)
                    # a hash stands once for each of its blocks
                    met = np.unique(np.stack([text[some], low[some], high[some]], axis=1), axis=0)
                    counts = met[:, 2] - met[:, 1]
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    pairs.append(np.stack([block[np.repeat(met[:, 1], counts) + nth], np.repeat(met[:, 0], counts)], axis=1))
                distinct = np.unique(np.concatenate(pairs), axis=0)
                part = batch.slice(texts.first, texts.count)
                for b in np.unique(distinct[:, 0]):
                    own = part.take(pa.array(distinct[distinct[:, 0] == b, 1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, b, dtype=np.int32)), *own.columns], names=["_block", "_row", "_text"])

    return rows.select("_row", "_text").mapInArrow(marked, "_block int, _row long, _text string")


@F.arrow_udf(T.StructType([T.StructField("runs", _PAIRS), T.StructField("spans", _PAIRS)]))
def _merged(pieces: pa.Array) -> pa.Array:
    """Runs with their spans, found by several automata: in order, those that touch as one."""
    out: list[list] = [[], []]
    for found in pieces.to_pylist():
        whole: list[list[int]] = []
        for first, last, begin, end in sorted((*p["runs"], *p["spans"]) for p in found or []):
            if whole and first <= whole[-1][1]:
                whole[-1][1], whole[-1][3] = max(last, whole[-1][1]), max(end, whole[-1][3])
            else:
                whole.append([first, last, begin, end])
        out[0].append([w[:2] for w in whole])
        out[1].append([w[2:] for w in whole])
    return pa.StructArray.from_arrays([pa.array(v, type=_ARROW[-1]) for v in out], names=["runs", "spans"])


def _routed(rows: DataFrame, blocks: Iterator[list[tuple[str, bytes]]], size: int) -> DataFrame:
    """As ``_scan`` for many blocks: each text meets the automata of the blocks whose hashes it has."""
    spark = rows.sparkSession
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    parts = []
    for group in _groups(blocks, size):
        path = new_path(spark, "candidates")
        _candidates(rows, group).write.partitionBy("_block").parquet(path)
        marked = spark.read.schema("_row long, _text string, _block int").parquet(path)
        for b, (items, _, _) in enumerate(group):
            hits = _scan(marked.filter(F.col("_block") == b).select("_row", "_text"), items, size)
            parts.append(durable(hits.filter(F.size("items") > 0).select("_row", "items", "runs", "spans"), "hits"))
    hits = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list(F.arrays_zip("runs", "spans"))).alias("pieces"),
    )
    hits = hits.select("_row", "items", _merged("pieces").alias("found")).select("_row", "items", "found.runs", "found.spans")
    lower = F.translate("_text", _UPPER, _LOWER)
    n_words = F.coalesce(F.regexp_count(lower, F.lit(_WORD.pattern)), F.lit(0)).cast("long")
    none = {"items": F.array().cast("array<string>"), "runs": F.array().cast(_PAIRS), "spans": F.array().cast(_PAIRS)}
    found = rows.withColumn("n_words", n_words).drop("_text").join(hits, "_row", "left").drop("_row")
    return found.withColumns({name: F.coalesce(name, empty) for name, empty in none.items()})


def items_digest(items: str = "items") -> Column:
    """SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def oracle(size: int = WINDOW) -> str:
    """DuckDB SQL for the rows of op4_decontamination: all windows of all texts, joined with those of the items."""
    def words(text: str) -> str:
        return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD.pattern}')"

    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS words FROM documents),
tokens AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts),
ahead AS (SELECT r, place, list(word) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS words FROM tokens),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words('text')} AS words FROM benchmark),
sized AS (SELECT item, words, least({size}, len(words)) AS n FROM items WHERE len(words) > 0),
starts AS (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM sized),
patterns AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS phrase FROM starts),
sizes AS (SELECT DISTINCT n FROM patterns),
windows AS (SELECT r, place, n, array_to_string(words[1 : n], ' ') AS phrase FROM ahead JOIN sizes ON len(words) >= n),
hits AS (SELECT r, place, n, item FROM windows JOIN patterns USING (n, phrase)),
hit_places AS (SELECT r, unnest(range(place, place + n)) AS place FROM (SELECT DISTINCT r, place, n FROM hits)),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM hit_places GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
