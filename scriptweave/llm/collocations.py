"""Phrase collocations: word sequences of two to five words that keep company beyond chance.

Texts are cut at punctuation and line ends into pieces, pieces at blanks into words. Only the longest windows
are counted: every word with the four behind it in its piece, padded where the piece ends. Spark's ROLLUP
over (language, first word, ..., fifth word) sums these counts into those of all shorter phrases, single words
and the language's total, since a phrase stands as often as windows begin with it.

A phrase of ``least`` occurrences has no pair of neighbours with fewer, so windows are padded from the first
rarer pair on, which changes no count of such a phrase and leaves few distinct windows; rarer words count for the
language's total only. Words and pairs are counted by their hashes; a bit table, sized by the number of frequent
ones and broadcast, tells them, and lets a few others pass. Where it would grow beyond ``TABLE_BITS`` there is none and windows stay whole: the result is the
same, from more shuffled rows.

Nulls: a null language is ``und``, a null or empty text has no words. Repeated rows count each. Pieces are
never joined, texts are read whole. Equal scores are ordered by occurrences and phrase. Columns besides language
and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.durable import durable
from . import bytewords
from .memory import released, small_batches

LONGEST, LEAST, TOP, PERCENT = 5, 100, 2000, 100
SLICE_BYTES, PART_BYTES = 4 << 20, 1 << 20
TABLE_BITS = 1 << 28
_BITS_PER_HASH = 32
# Hashes are counted by so many of their bits; two that meet only let more windows pass.
_TOLD = np.uint64((1 << 40) - 1)
_CUT = np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _CUT.copy()
_APART[[0x20, 0x09]] = True


def pieces(texts: bytewords.Texts) -> tuple[bytewords.Words, np.ndarray]:
    """The words, and whether the next one follows in the same piece."""
    w = bytewords.words(texts, _APART)
    cuts = np.cumsum(_CUT[texts.data])[w.starts] if len(w.starts) else np.zeros(0, dtype=np.int64)
    follows = np.zeros(len(w.starts), dtype=bool)
    follows[:-1] = (cuts[1:] == cuts[:-1]) & (w.text[1:] == w.text[:-1])
    return w, follows


@dataclass
class Tokens:
    """The words of some texts of a batch: bytes of the texts in lower case, where each word begins and ends there,
    its hash, its row in the batch, and whether the next one follows in the same piece."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row: np.ndarray
    follows: np.ndarray


def _tokens(column: pa.Array) -> Iterator[Tokens]:
    """The words of a column in slices of about ``SLICE_BYTES``, found in parts of ``PART_BYTES``, as finding them
    takes several times the memory of what is found."""
    parts: list[Tokens] = []
    size = 0
    for texts in bytewords.slices(column, lower=True, size=min(SLICE_BYTES, PART_BYTES)):
        w, follows = pieces(texts)
        parts.append(Tokens(texts.data, w.starts + size, w.ends + size, bytewords.word_hashes(texts, w), w.text + texts.first, follows))
        size += len(texts.data)
        if size >= SLICE_BYTES:
            yield _joined(parts)
            size = 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[Tokens]) -> Tokens:
    """One slice of its parts; the list is emptied."""
    names = [f.name for f in fields(Tokens)]
    columns = [[getattr(p, name) for p in parts] for name in names]
    parts.clear()
    return Tokens(*(np.concatenate(columns.pop(0)) for _ in names))


def _words(t: Tokens, salt: np.ndarray) -> np.ndarray:
    """A hash of each word and its language."""
    return bytewords.mix(t.hashes + salt[t.row])


def _pairs(t: Tokens, words: np.ndarray) -> np.ndarray:
    """A hash of each word, the next one and the language."""
    return bytewords.mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + t.hashes[1:])


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(hash): hashes of the words, and of the neighbours, that stand at least so often."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            salt = batch.column("salt").to_numpy().view(np.uint64)
            for t in _tokens(batch.column("text")):
                words = _words(t, salt)
                for found in (words, _pairs(t, words)[t.follows[:-1]]):
                    kinds, n = np.unique(found & _TOLD, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    made = rows.select("salt", "text").mapInArrow(counted, "hash long, n long")
    return made.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("hash")


class Table:
    """A bit for each hash; all set where there are too many hashes to tell them."""

    def __init__(self, hashes: DataFrame):
        hashes = durable(hashes, "hashes")
        wanted = max(1 << 10, hashes.count() * _BITS_PER_HASH)
        self.bits = 1 << int(wanted - 1).bit_length()
        self.shared = None
        if self.bits <= TABLE_BITS:
            slots = hashes.select(F.col("hash").bitwiseAND(self.bits - 1).alias("slot")).distinct().toArrow()
            bits = np.zeros(self.bits, dtype=bool)
            bits[slots.column("slot").to_numpy()] = True
            self.shared = hashes.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if self.shared is None:
            return np.ones(len(hashes), dtype=bool)
        slot = (hashes & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.shared.value[slot >> 3] >> (7 - (slot & 7))) & 1 == 1


def _windows(rows: DataFrame, table: Table, longest: int) -> DataFrame:
    """(lang, size, w1, w2, ..., n): the distinct windows of a slice; places behind ``size`` are empty. Words too rare
    for any phrase are windows of no words."""
    places = [f"w{k + 1}" for k in range(longest)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            salt = batch.column("salt").to_numpy().view(np.uint64)
            langs = batch.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy()
            for t in _tokens(batch.column("text")):
                if not len(t.hashes):
                    continue
                words = _words(t, salt)
                more = np.zeros(len(words) + longest, dtype=bool)
                more[: len(words) - 1] = t.follows[:-1] & table.passes(_pairs(t, words))
                kept = table.passes(words) | more[: len(words)]
                kept[1:] |= more[: len(words) - 1]
                rare = np.bincount(lang_of[t.row[~kept]], minlength=len(langs.dictionary))
                some = np.flatnonzero(rare)
                empty = pa.array([""] * len(some), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(some)), pa.array(np.zeros(len(some), dtype=np.int32)), *[empty] * longest, pa.array(rare[some])],
                    names=["lang", "size", *places, "n"],
                )
                open_ = np.flatnonzero(kept)
                _, at, kinds = np.unique(t.hashes[open_], return_index=True, return_inverse=True)
                word = np.zeros(len(kept), dtype=np.int64)
                word[open_] = kinds
                at = open_[at]
                known = [t.raw[a:b].tobytes() for a, b in zip(t.starts[at].tolist(), t.ends[at].tolist())]
                known = pa.array([*known, b""], pa.binary()).cast(pa.string())
                lang_at = lang_of[t.row]
                del t, words, kinds
                # windows that go on get a name for what they have so far, and so on with the next word
                name = lang_at[open_].astype(np.int64)
                for size in range(1, longest + 1):
                    _, first, name, n = np.unique(
                        name * len(at) + word[open_ + size - 1], return_index=True, return_inverse=True, return_counts=True
                    )
                    goes_on = more[open_ + size - 1] & (size < longest)
                    n -= np.bincount(name[goes_on], minlength=len(n))
                    begins = open_[first[n > 0]]
                    columns = [langs.dictionary.take(pa.array(lang_at[begins])), pa.array(np.full(len(begins), size, dtype=np.int32))]
                    for k in range(longest):
                        columns.append(known.take(pa.array(word[begins + k] if k < size else np.full(len(begins), len(at)))))
                    columns.append(pa.array(n[n > 0].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", *places, "n"])
                    open_, name = open_[goes_on], name[goes_on]

    schema = ", ".join(["lang string, size int", *[f"{p} string" for p in places], "n long"])
    return rows.mapInArrow(counted, schema)


def _rolled(windows: DataFrame, places: list[str], least: int) -> DataFrame:
    """(lang, words, n) of all beginnings of the windows, none of them included; those of two words or more only
    where they stand at least so often."""
    # the levels of ROLLUP have one more word each; without the language there is no row to keep
    level = len(places) - F.bit_count(F.grouping_id())
    rolled = windows.rollup("lang", *places).agg(F.sum("n").alias("n"), level.alias("level"), F.grouping("lang").alias("all"))
    rolled = rolled.filter("all = 0").filter((F.col("level") < 2) | (F.col("n") >= least))
    words = F.slice(F.array(*places), 1, F.greatest(F.lit(1), F.col("level").cast("int")))
    words = F.when(F.col("level") > 0, words).otherwise(F.array().cast("array<string>"))
    rolled = rolled.select("lang", words.alias("words"), "n")
    return rolled.filter((F.size("words") == 0) | (F.element_at(F.concat("words", F.array(F.lit("-"))), F.greatest(F.size("words"), F.lit(1))) != ""))


def phrase_counts(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """(lang, words, n): the phrases of one to ``longest`` words with at least ``least`` occurrences, and for
    each language no word at all with the number of its words."""
    named = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und"))
    rows = documents.select(named.alias("lang"), F.xxhash64(named).alias("salt"), F.col(f"`{text}`").alias("text"))
    with small_batches(documents.sparkSession):
        windows = durable(_windows(rows, Table(_frequent(rows, least)), longest), "windows")
    places = [f"w{k + 1}" for k in range(longest)]
    # single words are many of the windows; their empty places need no levels
    sums = _rolled(windows.filter("size < 2"), places[:1], least).unionAll(_rolled(windows.filter("size > 1"), places, least))
    sums = sums.groupBy("lang", "words").agg(F.sum("n").alias("n"))
    return durable(sums.filter((F.col("n") >= least) | (F.size("words") == 0)), "phrases")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    documents: DataFrame, top: int = TOP, least: int = LEAST, percent: int = PERCENT, longest: int = LONGEST,
    lang: str = "lang", text: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    ``score`` is floor(1000 a n / (l r)) at the cut that makes it least. A phrase inside a longer one that
    stands at ``percent`` of its occurrences or more is left out.
    """
    counts = phrase_counts(documents, least, longest, lang, text)
    totals = counts.filter(F.size("words") == 0).select("lang", F.col("n").alias("total"))
    named = counts.filter(F.size("words") > 0).select("lang", _phrase(F.col("words")).alias("phrase"), "words", "n")
    candidates = named.filter(F.size("words") > 1).withColumnRenamed("n", "a")

    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.withColumn("first", _phrase(F.slice("words", F.lit(1), F.col("k"))))
    cut = cut.withColumn("rest", _phrase(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))))
    for side, count in (("first", "l"), ("rest", "r")):
        cut = cut.join(named.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    wide = {c: f"CAST({c} AS DECIMAL(38, 0))" for c in ("a", "total", "l", "r")}
    score = F.expr(f"(1000 * {wide['a']} * {wide['total']}) div ({wide['l']} * {wide['r']})")
    cut = cut.join(totals, "lang").withColumn("score", score)
    best = cut.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("least")
    )

    def parts(words: Column) -> Column:
        """All shorter phrases of two words or more inside."""
        size = F.size(words)
        starts = F.sequence(F.lit(1), size - 1)
        inside = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), size - i + 1), lambda n: F.slice(words, i, n))))
        return F.filter(inside, lambda x: F.size(x) < size)

    longer = candidates.filter(F.size("words") > 2).select("lang", F.explode(parts(F.col("words"))).alias("part"), "a")
    longer = longer.groupBy("lang", _phrase(F.col("part")).alias("phrase")).agg(F.max("a").alias("inside"))
    rows = best.join(longer, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a")))
    rows = rows.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(top: int = TOP, least: int = LEAST, percent: int = PERCENT, longest: int = LONGEST) -> str:
    """The same in SQL, with a list of all phrases."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i : i + k - 1] AS words FROM i, (SELECT unnest(range(1, {longest + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, words, array_to_string(words, ' ') AS phrase, count(*) AS n FROM g GROUP BY lang, words),
n AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE len(words) = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, n AS a FROM f WHERE len(words) > 1 AND n >= {least}),
k AS (SELECT c.*, unnest(range(1, len(words))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, x.n AS l, y.n AS r, n.n, k, CAST((CAST(1000 AS HUGEINT) * a * n.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.words[:k], ' ')
      JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.words[k + 1 :], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS longer ON longer.lang = c.lang AND len(longer.words) > len(c.words)
      AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * longer.a >= {percent} * c.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b ANTI JOIN d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= {top}"""
