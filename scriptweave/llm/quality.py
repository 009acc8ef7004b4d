"""Quality rules: counts over whole texts, and a hashed n-gram logistic regression.

The model sees runs of one and two words and of three and five bytes, each hashed to 2^15 places of
its kind, as shares of the text's runs of that kind. It is fitted on a bounded sample of labelled
rows, calibrated on rows kept out of the fit, and scored in Arrow batches against fixed thresholds.
Because a score is a mean of weights, scoring looks up one weight per run and adds up.

Null and empty texts have no words: all counts are 0, the score is that of no evidence, and they fail
the base rules. Repeated rows get the same result each. Further columns are carried along; a
result replaces a column of its name. Without labels of both kinds there is no model and only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.durable import durable
from . import bytewords
from .labelled import fit_logistic, held_out, labelled_sample, sigmoid

MAX_LABELLED = 6_000
DIM_BITS = 15
DIM = 1 << DIM_BITS
WORD_RUNS, BYTE_RUNS = (1, 2), (3, 5)
KINDS = len(WORD_RUNS) + len(BYTE_RUNS)
KEEP_AT = 0.5
# Shares are small; one scale lets all kinds learn at one pace.
SCALE = 50.0
BLOCK_ROWS, ROUNDS, MIN_STEPS = 256, 10, 200
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _byte_runs(data: np.ndarray, size: int) -> np.ndarray:
    """The place of each run of ``size`` bytes; the last ``size - 1`` are of no use."""
    code = np.zeros(len(data), dtype=np.uint64)
    for k in range(size):
        n = max(0, len(data) - k)
        code[:n] |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def features(texts: bytewords.Texts, w: bytewords.Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the places of all runs, and their bounds (first, behind the last) by text."""
    for size in WORD_RUNS:
        first = w.bounds[:-1]
        last = np.maximum(first, w.bounds[1:] - size + 1)
        code = hashes
        for k in range(1, size):
            code = bytewords.mix(code * np.uint64(3) + np.concatenate([hashes[k:], hashes[:k]]))
        yield (code >> np.uint64(64 - DIM_BITS)).astype(np.int64), np.stack([first, last])
    for size in BYTE_RUNS:
        first = texts.bounds[:-1]
        yield _byte_runs(texts.data, size), np.stack([first, np.maximum(first, texts.bounds[1:] - size + 1)])


@dataclass
class Model:
    """Weights by kind and place, and the line that turns a score into a probability."""

    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: bytewords.Texts, w: bytewords.Words, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(texts.count)
        for kind, (places, (first, last)) in enumerate(features(texts, w, hashes)):
            total = np.concatenate([[0.0], np.cumsum(self.weights[kind][places], dtype=np.float64)])
            out += (total[last] - total[first]) / np.maximum(last - first, 1)
        return out

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return sigmoid(scores * self.slope + self.offset)


def _sparse(sample: DataFrame) -> DataFrame:
    """Each sampled text's places (kind * DIM + place, four bytes each) and their shares (the same)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in bytewords.slices(batch.column("text")):
                w = bytewords.words(texts)
                kinds = list(features(texts, w, bytewords.word_hashes(texts, w)))
                places, shares = [], []
                for i in range(texts.count):
                    found = [
                        np.unique(p[a[i] : b[i]], return_counts=True) for p, (a, b) in kinds
                    ]
                    places.append(np.concatenate([k * DIM + p for k, (p, _) in enumerate(found)]).astype("<i4").tobytes())
                    shares.append(np.concatenate([n / max(1, n.sum()) for _, n in found]).astype("<f4").tobytes())
                part = batch.slice(texts.first, texts.count)
                columns = [part.column("label"), part.column("test"), pa.array(places, pa.binary()), pa.array(shares, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "test", "places", "shares"])

    return sample.select("text", "label", held_out(F.col("_key")).alias("test")).mapInArrow(
        rows, "label int, test boolean, places binary, shares binary"
    )


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model | None:
    """The model of at most ``most`` labelled rows, which the driver holds as sparse shares.

    They come to the driver a partition at a time. Adam goes ``rounds`` times through blocks of rows
    drawn in a fixed order, with steps that shrink to nothing.
    """
    sample = durable(_sparse(labelled_sample(documents, labels, label, most)), "shares")
    rows, y, test = [], [], []
    for row in sample.toLocalIterator():
        rows.append((np.frombuffer(row.places, dtype="<i4"), np.frombuffer(row.shares, dtype="<f4")))
        y.append(row.label)
        test.append(row.test)
    y, test = np.array(y, dtype=np.float64), np.array(test, dtype=bool)
    train = np.flatnonzero(~test)
    if len(set(y[train])) < 2:
        return None
    size = KINDS * DIM
    weights, mean, spread = np.zeros(size), np.zeros(size), np.zeros(size)
    bias = bias_mean = bias_spread = 0.0

    def block(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows: the row of each share, its place, the share."""
        lengths = [len(rows[i][0]) for i in at]
        return np.repeat(np.arange(len(at)), lengths), np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at])

    def raw_of(row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=value * weights[index], minlength=n) * SCALE + bias

    # both labels weigh the same in all
    balance = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * len(train)
    draw = np.random.default_rng(0)
    blocks = -(-len(train) // BLOCK_ROWS)
    steps = max(rounds * blocks, MIN_STEPS)
    order: list[np.ndarray] = []
    for step in range(1, steps + 1):
        order = order or np.array_split(draw.permutation(train), blocks)
        at = order.pop()
        row, index, value = block(at)
        error = (sigmoid(raw_of(row, index, value, len(at))) - y[at]) * balance[at] / len(at)
        slope = 1e-5 * weights + np.bincount(index, weights=value * error[row], minlength=size) * SCALE
        rate = 0.03 * (1 - (step - 1) / steps)
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-7)
        bias_mean, bias_spread = 0.9 * bias_mean + 0.1 * error.sum(), 0.99 * bias_spread + 0.01 * error.sum() ** 2
        bias -= rate * (bias_mean / (1 - 0.9**step)) / (np.sqrt(bias_spread / (1 - 0.99**step)) + 1e-7)
    every = np.array_split(np.arange(len(y)), -(-len(y) // BLOCK_ROWS))
    raw = np.concatenate([raw_of(*block(at), len(at)) for at in every])
    kept_out = test if len(set(y[test])) == 2 else ~test
    slope, offset = fit_logistic(raw[kept_out, None], y[kept_out], ridge=0.1)
    return Model((weights * SCALE).reshape(KINDS, DIM).astype(np.float32), float(slope), float(offset + slope * bias))


def _repeat_words(w: bytewords.Words, hashes: np.ndarray, count: int) -> np.ndarray:
    """By text: words inside a window that the text has twice or more."""
    long_enough = np.diff(w.bounds) >= REPEAT_WINDOW
    codes, first = bytewords.shingle_hashes(hashes, w, REPEAT_WINDOW)
    whole = long_enough[w.text[first]] if len(first) else np.zeros(0, dtype=bool)
    codes, first = codes[whole], first[whole]
    codes = bytewords.mix(codes ^ bytewords.mix(w.text[first].astype(np.uint64) + np.uint64(1)))
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = first[counts[back] > 1]
    change = np.zeros(len(w.starts) + REPEAT_WINDOW, dtype=np.int64)
    change[twice] += 1
    change[twice + REPEAT_WINDOW] -= 1
    return bytewords.per_text(np.cumsum(change)[: len(w.starts)] > 0, w.bounds)


def _repeat_lines(texts: bytewords.Texts) -> np.ndarray:
    """By text: lines with a word that equal an earlier line."""
    raw = texts.data.tobytes()
    out = np.zeros(texts.count, dtype=np.int64)
    for i in range(texts.count):
        lines = raw[texts.bounds[i] : texts.bounds[i + 1]].split(b"\n")
        if len(lines) > 1:
            real = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            out[i] = len(real) - len(set(real))
    return out


_RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assessed(
    documents: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, keep_at: float = KEEP_AT
) -> DataFrame:
    """Adds the five counts, base_failed, score (calibrated probability of quality) and kept.

    ``keep`` names the columns to carry (default: all). Nothing is shuffled.
    """
    added = [T.StructField(c, T.LongType()) for c in _RESULT]
    added += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    results = {f.name for f in added}
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in results]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed size, whatever the tables' size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for texts in bytewords.slices(batch.column("_text")):
                w = bytewords.words(texts)
                hashes = bytewords.word_hashes(texts, w)
                data = texts.data
                n_words = np.diff(w.bounds)
                point = (data & 0xC0) != 0x80
                points = np.concatenate([[0], np.cumsum(point)])
                counts = [
                    n_words,
                    bytewords.per_text(points[w.ends] - points[w.starts], w.bounds),
                    bytewords.per_text(_SYMBOL[data], texts.bounds),
                    _repeat_lines(texts),
                    _repeat_words(w, hashes, texts.count),
                ]
                failed = (n_words < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * n_words)
                score = np.ones(texts.count) if model is None else model.probability(model.scores(texts, w, hashes))
                part = batch.slice(texts.first, texts.count)
                arrays = [part.column(f"_{i}") for i in range(len(keep))]
                arrays += [pa.array(c.astype(np.int64)) for c in counts]
                arrays += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]
                names = [*keep, *_RESULT, "base_failed", "score", "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = documents.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    return source.mapInArrow(rows, T.StructType([documents.schema[c] for c in keep] + added))
