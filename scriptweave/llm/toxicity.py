"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding undoes disguises: compatibility forms, letters of other scripts that look Latin, zero-width
characters, and digits or signs put for letters. Entries are whole words and beginnings of words; one
automaton finds them all in one scan, and a word counts with its heaviest entry. A match inside an
exception phrase does not count. The sum of weights, as it is and by length, becomes a score between
0 and 1.

Lexicon, exceptions and score are learned from a bounded sample of labelled documents: an entry's
weight is the log ratio of its document frequencies in toxic and other documents, and an exception is
a two-word phrase around an entry that stands mostly in documents that are not toxic.

Null and empty texts have no matches and get the lowest score. Repeated rows get the same score each.
Further columns are carried along. Without labels of both kinds the lexicon is empty and all scores are 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .labelled import fit_logistic, labelled_sample, sigmoid
from .memory import released, small_batches

MAX_LABELLED = 20_000
MIN_DOCUMENTS, MIN_WEIGHT = 4, 3.0
PREFIXES = (4, 5, 6)
LENGTH_OFFSET = 30
_FLUSH = 150_000

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip(
    "аеорсухіјѕԁԛαεινορτυκıɡɩ",
    "aeopcyxijsdlaeivoptukigi",
))
# Digits and signs put for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
_TABLE = {ord(a): b for a, b in {**HOMOGLYPHS, **SUBSTITUTES}.items()}
_TABLE |= dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SIGN = re.compile(r"(?<=[a-z])[@$!](?=[a-z])|(?<![^\s])[@$](?=[a-z])")
_WORD = re.compile(r"\w+")


def folded_words(text: str | None) -> list[str]:
    """The words of the folded text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_TABLE)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return _WORD.findall(text)


def entries_of(word: str) -> Iterator[str]:
    """The entries that could match a word: itself, between bars, and its beginnings."""
    yield f"|{word}|"
    for n in PREFIXES:
        if len(word) > n:
            yield f"|{word[:n]}"


@dataclass
class Lexicon:
    """Entry weights, exception phrases, and the line from the two features to a log odds."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    line: tuple[float, float, float] | None = None

    def __post_init__(self):
        self._machine = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "line": self.line, "_machine": None}

    def matches(self, words: list[str]) -> list[tuple[int, float]]:
        """(word number, weight of its heaviest entry) of all words with one, without exceptions."""
        if not self.weights or not words:
            return []
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry) - 1, weight))
            self._machine.make_automaton()
        joined = f"|{'|'.join(words)}|"
        best: dict[int, float] = {}
        for end, (back, weight) in self._machine.iter(joined):
            start = end - back
            best[start] = max(weight, best.get(start, 0.0))
        found, at, word = [], 0, 0
        for start in sorted(best):
            word += joined.count("|", at, start)
            at = start
            found.append((word, best[start]))
        if self.exceptions:
            found = [(i, x) for i, x in found if not any(p in self.exceptions for p in phrases(words, i))]
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        words = folded_words(text)
        total = sum(x for _, x in self.matches(words))
        return math.log1p(total), math.log1p(100 * total / (len(words) + LENGTH_OFFSET))

    def score(self, text: str | None) -> float:
        if self.line is None:
            return 0.0
        a, b = self.features(text)
        return float(sigmoid(np.array(self.line[0] * a + self.line[1] * b + self.line[2])))


def phrases(words: list[str], i: int) -> list[str]:
    """The two-word phrases in which a word stands."""
    out = [f"{words[i - 1]} {words[i]}"] if i else []
    return out + [f"{words[i]} {words[i + 1]}"] if i + 1 < len(words) else out


def _document_counts(sample: DataFrame, found) -> DataFrame:
    """(entry, toxic documents, other documents), each task adding up its own texts first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(keys, pa.string())] + [pa.array([c[k] for k in keys], pa.int64()) for c in counts]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["entry", "others", "toxic"])

        for batch in released(batches):
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                counts[1 if label else 0].update(found(folded_words(text.as_py())))
                if len(counts[0]) + len(counts[1]) > _FLUSH:
                    yield flushed()
        yield flushed()

    made = sample.select("text", "label").mapInArrow(rows, "entry string, others long, toxic long")
    return made.groupBy("entry").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))


def _entries(words: list[str]) -> set[str]:
    return {e for w in set(words) for e in entries_of(w)}


def learn(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
    most: int = MAX_LABELLED,
) -> Lexicon:
    """The lexicon of at most ``most`` labelled documents: all entries that pass the thresholds, which the
    sample bounds."""
    with small_batches(documents.sparkSession):
        return _learned(labelled_sample(documents, labels, label, most, key, text))


def _learned(sample: DataFrame) -> Lexicon:
    sizes = dict(sample.groupBy("label").count().collect())
    if len(sizes) < 2:
        return Lexicon({})
    toxic, others = sizes.get(1, 0) + 1.0, sizes.get(0, 0) + 1.0
    weight = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("others") + 0.5) / others)
    counts = _document_counts(sample, _entries).withColumn("weight", weight)
    chosen = counts.filter((F.col("toxic") >= MIN_DOCUMENTS) & (F.col("weight") >= MIN_WEIGHT))
    chosen = chosen.select("entry", "weight")
    lexicon = Lexicon(dict(map(tuple, chosen.collect())))

    # Words that are toxic elsewhere but not in this company: at least as often in other documents as
    # their share of all documents would give.
    near = _document_counts(sample, lambda w: {p for i, _ in lexicon.matches(w) for p in phrases(w, i)})
    harmless = near.filter((F.col("others") >= MIN_DOCUMENTS) & (F.col("others") / others >= F.col("toxic") / toxic))
    lexicon.exceptions = {r[0] for r in harmless.select("entry").collect()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1]), batch.column("label")], names=["a", "b", "label"])

    table = sample.select("text", "label").mapInArrow(measured, "a double, b double, label int").toArrow()
    x = np.column_stack([table.column("a").to_numpy(), table.column("b").to_numpy()])
    lexicon.line = tuple(fit_logistic(x, table.column("label").to_numpy().astype(float), ridge=0.01))
    return lexicon


def scored(documents: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1), which replaces a column of that name. ``keep`` names the columns to carry
    (default: all). Nothing is shuffled, and of a row only the text goes to Python."""
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() != "score"]
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample it is learned from

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            yield pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    # as if it were not deterministic: each row is scored once, however often the score is used
    scores = score.asNondeterministic()(F.col(f"`{text}`"))
    return documents.select(*[F.col(f"`{c}`") for c in keep], scores.alias("score"))
