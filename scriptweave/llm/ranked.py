"""Ranked lexical search: the best documents for each item, by presence masks.

One pass over the texts keeps, block by block, which documents hold which of the items' terms and how often
(inverted lists), and adds up the statistics of the whole corpus. In a block, each item's documents get a bit
mask of the terms they hold; equal masks are a group, and the largest share each term has anywhere in the block
bounds a group's score. Groups are scored from the highest bound down until the next bound is below the worst
of the best found so far, by this task in this block or any before. Every task hands on its best for each item;
these are ranked again.

Items are the stated query set: they are taken in blocks of ``BLOCK_TERMS`` terms, and the texts are scanned
once for each block. Nothing else than items and their statistics is broadcast, and no document is compared
with another.

A null or empty text has no terms: it is not counted and never found. Items without terms find nothing. Rows
that repeat a document are ranked each, rows that repeat an item are answered each. Equal scores are ordered
by document id, null last. Texts are read whole. Columns besides id and text are not looked at. Without
documents there are no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..operators.durable import durable
from . import bytewords

TOP = 20
BLOCK_TERMS = 1 << 20
BLOCK_DOCUMENTS = 8192
_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms(texts: bytewords.Texts) -> tuple[bytewords.Words, np.ndarray]:
    """Runs of ASCII letters, digits and everything beyond ASCII, and their hashes."""
    w = bytewords.words(texts, _APART)
    return w, bytewords.word_hashes(texts, w)


@dataclass
class Items:
    """A block of items: their ids, and for each its terms' numbers and how often it has each."""

    ids: list
    known: np.ndarray
    numbers: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        hashes = []
        for texts in bytewords.slices(pa.array([text for _, text in rows], pa.string()), lower=True):
            w, found = terms(texts)
            hashes += [found[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        every = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        items = cls([i for i, _ in rows], np.unique(every))
        for found in hashes:
            kinds, times = np.unique(found, return_counts=True)
            items.numbers.append(np.searchsorted(items.known, kinds))
            items.times.append(times.astype(np.int64))
        return items


def _blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[Items]:
    rows, held = [], 0
    for row in items.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        rows.append(tuple(row))
        held += len(row[1] or "") // 2 + 1
        if held >= most:
            yield Items.of(rows)
            rows, held = [], 0
    if rows:
        yield Items.of(rows)


def _lists(documents: DataFrame, known: np.ndarray, key: str, text: str) -> DataFrame:
    """A row for each block: how many documents have terms and how many terms, and of those that hold any
    of the known: id, length, and (term, document, times) in order of the term."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[tuple] = []
        documents = 0

        def block() -> pa.RecordBatch:
            ids, sizes, term, doc, times = [], [], [], [], []
            base = 0
            for one in held:
                ids.append(one[0])
                sizes.append(one[1])
                term.append(one[2])
                doc.append(one[3] + base)
                times.append(one[4])
                base += len(one[1])
            term, doc, times = (np.concatenate(x).astype(np.int32) for x in (term, doc, times))
            order = np.argsort(term, kind="stable")
            columns = [sum(x[5] for x in held), sum(x[6] for x in held), pa.concat_arrays(ids).to_pylist()]
            columns += [np.concatenate(sizes).astype(np.int64).tobytes(), *(x[order].tobytes() for x in (term, doc, times))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            for texts in bytewords.slices(batch.column("text"), lower=True):
                w, hashes = terms(texts)
                sizes = np.diff(w.bounds)
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, dtype=np.int64)
                pair, times = np.unique(w.text[hit].astype(np.int64) * max(1, len(known)) + at[hit], return_counts=True)
                text, term = np.divmod(pair, max(1, len(known)))
                with_any, doc = np.unique(text, return_inverse=True)
                ids = batch.column("id").slice(texts.first, texts.count).take(pa.array(with_any))
                held.append((ids, sizes[with_any], term, doc, times, int((sizes > 0).sum()), int(sizes.sum())))
                documents += texts.count
                if documents >= BLOCK_DOCUMENTS:
                    yield block()
                    held, documents = [], 0
        if held:
            yield block()

    names = ["documents", "terms", "ids", "sizes", "term", "doc", "times"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = "documents long, terms long, ids array<long>, sizes binary, term binary, doc binary, times binary"
    return rows.mapInArrow(listed, schema)


def _frequencies(lists: DataFrame) -> DataFrame:
    """(term, n): documents that hold a term; each task adds up its own blocks first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column("term"):
                kinds, n = np.unique(np.frombuffer(x.as_buffer(), dtype=np.int32), return_counts=True)
                total.update(dict(zip(kinds.tolist(), n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return lists.select("term").mapInArrow(rows, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Block:
    """The inverted lists of a block, with each place's share of a term's weight."""

    ids: np.ndarray
    null: np.ndarray
    doc: np.ndarray
    share: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, row: dict, documents: int, all_terms: int, known: int) -> Block:
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        term, doc, times = (np.frombuffer(row[c], dtype=np.int32) for c in ("term", "doc", "times"))
        length = 100 - 25 + 25 * sizes * documents // all_terms
        times = times.astype(np.int64)
        share = 1_000_000_000 * times // (1000 * times + 12 * length[doc])
        ids = np.array([0 if i is None else i for i in row["ids"]], dtype=np.int64)
        null = np.array([i is None for i in row["ids"]], dtype=bool)
        return cls(ids, null, doc, share, np.searchsorted(term, np.arange(known + 1)))

    def holding(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[term], self.bounds[term + 1]
        return self.doc[a:b], self.share[a:b]


class Best:
    """The best documents of an item so far, best first."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    @property
    def least(self) -> int:
        """A lower score is of no use."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        score = np.concatenate([self.score, score[good]])
        id_, null = np.concatenate([self.id, id_[good]]), np.concatenate([self.null, null[good]])
        order = np.lexsort((id_, null, -score))[: self.top]
        self.score, self.id, self.null = score[order], id_[order], null[order]


def search(block: Block, numbers: np.ndarray, values: np.ndarray, best: Best) -> int:
    """Improves an item's best by the block's documents; ``values`` are weights times repeats. Returns how
    many documents were scored."""
    lists = [(v, *block.holding(t)) for t, v in zip(numbers.tolist(), values.tolist())]
    lists = [(v, doc, share) for v, doc, share in lists if v > 0 and len(doc)]
    if not lists:
        return 0
    words = -(-len(lists) // 64)
    masks = np.zeros((len(block.ids), words), dtype=np.uint64)
    for k, (_, doc, _) in enumerate(lists):
        masks[doc, k // 64] |= np.uint64(1 << k % 64)
    held = np.flatnonzero(masks.any(axis=1))
    masks = masks[held]
    if words == 1:
        groups, back = np.unique(masks[:, 0], return_inverse=True)
        groups = groups[:, None]
    else:
        groups, back = np.unique(masks, axis=0, return_inverse=True)
    bound = np.zeros(len(groups), dtype=np.int64)
    for k, (value, _, share) in enumerate(lists):
        bound += ((groups[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64) * (value * int(share.max()))
    order = np.argsort(-bound, kind="stable")
    place = np.argsort(order)[back]
    by_group = np.argsort(place, kind="stable")
    ends = np.searchsorted(place[by_group], np.arange(len(order)), side="right")
    at = scored = 0
    step = best.top
    while at < len(order) and bound[order[at]] >= best.least:
        first = ends[at - 1] if at else 0
        # as many whole groups as hold ``step`` documents, of those that may still matter
        upto = int(np.searchsorted(-bound[order], -best.least, side="right"))
        to = max(at + 1, min(upto, int(np.searchsorted(ends, first + step)) + 1))
        some = np.sort(held[by_group[first : ends[to - 1]]])
        score = np.zeros(len(some), dtype=np.int64)
        for value, doc, share in lists:
            i = np.minimum(np.searchsorted(doc, some), len(doc) - 1)
            score += np.where(doc[i] == some, value * share[i], 0)
        best.add(score, block.ids[some], block.null[some])
        scored += len(some)
        at, step = to, 4 * step
    return scored


def _best(lists: DataFrame, items: Items, weights: np.ndarray, documents: int, all_terms: int, top: int, item: T.StructField) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best for each item."""
    shared = lists.sparkSession.sparkContext.broadcast((items, weights))  # one block of items

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(top) for _ in items.ids]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, documents, all_terms, len(items.known))
                for numbers, times, found in zip(items.numbers, items.times, best):
                    search(block, numbers, weights[numbers] * times, found)
        count = [len(b.score) for b in best]
        ids = np.concatenate([b.id for b in best])
        columns = [pa.array(np.repeat(np.arange(len(best)), count), pa.int32())]
        columns += [pa.array(ids, pa.int64(), mask=np.concatenate([b.null for b in best]))]
        columns += [pa.array(np.concatenate([b.score for b in best]), pa.int64())]
        names = pa.array(items.ids, kind).take(columns[0])
        yield pa.RecordBatch.from_arrays([columns[0], names, *columns[1:]], names=["item", "item_id", "doc_id", "score"])

    kind = pa.schema([("item_id", _arrow(item.dataType))]).field(0).type
    schema = [T.StructField("item", T.IntegerType()), T.StructField("item_id", item.dataType)]
    schema += [T.StructField(c, T.LongType()) for c in ("doc_id", "score")]
    return lists.select("ids", "sizes", "term", "doc", "times").mapInArrow(rows, T.StructType(schema))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ranked(
    documents: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0."""
    spark, found = documents.sparkSession, None
    for block in _blocks(items, item, item_text, block_terms):
        if not len(block.known):
            continue
        lists = durable(_lists(documents, block.known, key, text), "lists")
        sums = lists.agg(F.sum("documents"), F.sum("terms")).first()
        if not sums[0]:
            continue
        weights = np.zeros(len(block.known), dtype=np.int64)
        for term, n in _frequencies(lists).collect():  # one row for each term of the block of items
            weights[term] = weight(sums[0], n)
        rows = _best(lists, block, weights, sums[0], sums[1], top, items.schema[item])
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        rows = rows.select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionAll(rows)
    if found is not None:
        return found
    names = ["item_id", "rank", "doc_id", "score"]
    kinds = [items.schema[item].dataType, T.IntegerType(), T.LongType(), T.LongType()]
    return spark.createDataFrame([], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def oracle(top: int = TOP) -> str:
    """The same in SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split} AS t FROM documents),
c AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
q AS (SELECT row_number() OVER () AS qid, item_id, {split} AS t FROM benchmark),
u AS (SELECT qid, item_id, term, count(*) AS often FROM (SELECT qid, item_id, unnest(t) AS term FROM q) GROUP BY qid, item_id, term),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM u) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, c.n),
p AS (SELECT f.rid, d.doc_id, f.term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.t) * c.n) // c.l)) AS share
      FROM f JOIN d ON d.rid = f.rid, c),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(often * w * share) AS BIGINT) AS score
      FROM u JOIN p ON p.term = u.term JOIN w ON w.term = u.term GROUP BY qid, item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {top}"""
