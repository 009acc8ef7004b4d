"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Each shingle throws one exponential point per register,
the j-th of which lies in the j-th of equally likely intervals (so they are truncated, ascending, and
mostly need not be looked at), and visits the registers in its own order. A register keeps the
exponent of the smallest point on a scale of powers of 1.1. Registers of a union are the larger ones,
and equal registers tell alike sets, so bands of them find candidates. A pair's registers that are
larger, smaller and equal give the likelihood of each similarity; only pairs for which the threshold is
beyond doubt out of reach are dropped. The rest is confirmed on full sets, as ``near`` says.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.durable import durable
from . import bytewords
from .memory import small_batches
from .near import distinct_codes, near_components, signatures

REGISTERS, BANDS, PER_BAND = 160, 32, 5
BASE, RATE = 1.1, 20.0
# A pair is dropped when its likelihood at the threshold is e^-DOUBT of the best: once in some
# five million pairs that do reach it.
DOUBT = 13.0
_STEPS = np.array([s for s in range(1, REGISTERS) if np.gcd(s, REGISTERS) == 1])


def sketch(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS, 0 to 255) of the texts' code sets."""
    m, texts = REGISTERS, len(bounds) - 1
    least = np.full(texts * m, np.inf)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    seed = bytewords.mix(codes ^ np.uint64(0x5E75CE7C))
    register = (seed % np.uint64(m)).astype(np.int64)
    step = _STEPS[((seed >> np.uint64(32)) % np.uint64(len(_STEPS))).astype(np.int64)]
    for j in range(m):
        if not len(text):
            break
        share = (bytewords.mix(seed + np.uint64(j + 1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        np.minimum.at(least, text * m + register, (j + share) / m)
        # later points all lie above (j + 1) / m
        open_ = (least.reshape(texts, m).max(axis=1) > (j + 1) / m)[text]
        text, seed, step = text[open_], seed[open_], step[open_]
        register = (register[open_] + step) % m
    with np.errstate(divide="ignore"):
        point = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
        scaled = np.floor(1 - np.log(point) / np.log(BASE))
    return np.clip(scaled, 0, 255).astype(np.uint8).reshape(texts, m)


def _log_likelihood(j, u, v, above, below, equal):
    def p(x):
        return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches of sets of known sizes may be alike to the percentage."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    wanted = np.minimum(percent / 100, most)
    at = _log_likelihood(wanted, u, v, above, below, equal)
    # the likelihood is concave: what a grid below the threshold cannot better, nothing does; a coarse one tells most
    grid = np.linspace(0, 1, 41)[:-1]
    coarse = np.arange(len(grid)) % 10 == 0
    left, best = np.arange(len(at)), at
    for shares in (grid[coarse], grid[~coarse]):
        for share in shares:
            best = np.maximum(best, _log_likelihood(wanted[left] * share, u[left], v[left], above[left], below[left], equal[left]))
        near = best - at[left] <= DOUBT
        left, best = left[near], best[near]
    out = np.zeros(len(at), dtype=bool)
    out[left] = True
    return out


def near_documents(
    documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id): the smallest key among the documents that are linked.

    Words are runs without white space of the text with A-Z lower-cased; a text of fewer than ``words``
    is one shingle. Null and empty texts, and texts of white space, have none and stay alone. Every row
    gets a result, by its own text: rows that share a key, or have none, are documents of their own. A
    component without any key has none (null).
    """
    rows = _components(documents, words, percent, key, text)
    return rows.select(F.col("key").alias(key), "n_shingles", F.col("first.key").alias("component_id"))


def row_id(key: str, text: str) -> Column:
    """What tells rows apart in comparing: a hash of key and text. Rows equal in both are one."""
    return F.xxhash64(F.col(f"`{key}`").cast("long"), f"`{text}`")


def first_rows(documents: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row): by ``row_id`` the documents of which a copy, exact or near, comes before, by key (null last) and
    row; empty ones are nobody's copies."""
    rows = _components(documents, words, percent, key, text)
    return rows.filter((F.col("n_shingles") > 0) & (F.col("id") != F.col("first.id"))).select(F.col("id").alias("row")).distinct()


def _components(documents: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(key, id, n_shingles, first): of each row its component's first row (is null, key, id)."""
    with small_batches(documents.sparkSession):
        return _found_components(documents, words, percent, key, text)


def _found_components(documents: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:

    def shingler(texts: bytewords.Texts):
        w = bytewords.words(texts)
        codes, first = bytewords.shingle_hashes(bytewords.word_hashes(texts, w), w, words)
        return distinct_codes(codes, w.text[first], texts.count)

    items = documents.select(F.col(f"`{key}`").cast("long").alias("key"), row_id(key, text).alias("id"), F.col(f"`{text}`").alias("text"))
    signed = durable(signatures(items, shingler, sketch), "signed")
    same = ["n", "fp1", "fp2"]
    own = F.struct(F.col("key").isNull().alias("none"), "key", "id")
    # a class is named after one of its rows, whose text stands for it
    classes = signed.filter("n > 0").groupBy(*same).agg(F.min("id").alias("id"), F.min(own).alias("first"), F.first("registers").alias("registers"))
    classes = durable(classes, "classes")
    found = near_components(classes, items.select("id", "text"), shingler, possible, BANDS, PER_BAND, percent)
    named = classes.join(found, classes["id"] == found["node"], "left").withColumn("component", F.coalesce("component", "id"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    named = named.select("component", *[F.col(c).alias(f"_{c}") for c in same]).join(firsts, "component")
    equal = (F.col("n") == F.col("_n")) & (F.col("fp1") == F.col("_fp1")) & (F.col("fp2") == F.col("_fp2"))
    rows = signed.select("key", "id", *same).join(named, equal, "left")
    return rows.select("key", "id", F.col("n").alias("n_shingles"), F.coalesce("first", own).alias("first"))
