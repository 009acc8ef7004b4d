"""Token ids in ORC files.

Texts are encoded in Arrow batches and written, in order of document id, as ORC with integer run-length
encoding, row indexes, and a Bloom filter on the document id: readers work stripe by stripe, and a
look-up of an id skips the files, stripes and row groups that cannot hold it.

Null and empty texts are documents of just the end id. Repeated ids keep one row for each, ordered by
a hash of the text. Null document ids come first. Further columns are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..operators.durable import durable
from . import bytewords
from .memory import released, small_batches

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1_000
CACHE_PIECES = 500_000
# Between blanks, a control character that is one id of its own.
_MARK = "\x01"
_AT_ONCE = 200
# Signs that a tokenizer parts from a letter before them; the apostrophe is none of them (it's).
_SIGN = np.zeros(256, dtype=bool)
_SIGN[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_MAX_SIGNS = 8
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# Second bytes, behind 0xC3, of the Latin-1 letters (all but the signs of times and division).
_LATIN_LETTER = np.zeros(256, dtype=bool)
_LATIN_LETTER[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def pieces_of(texts: bytewords.Texts, signs_apart: bool) -> bytewords.Words:
    """The runs between blanks. With ``signs_apart`` up to eight signs at a run's end are a piece of their
    own where an ASCII or Latin-1 letter is before them; the ids are the same either way."""
    w = bytewords.words(texts)
    if not signs_apart or not len(w.starts):
        return w
    data, cut = texts.data, w.ends.copy()
    open_ = np.arange(len(cut))
    for _ in range(_MAX_SIGNS):
        open_ = open_[_SIGN[data[cut[open_] - 1]]]
        cut[open_] -= 1
        open_ = open_[cut[open_] > w.starts[open_]]
    apart = (cut < w.ends) & (cut > w.starts)
    last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
    apart &= _ASCII_LETTER[last] | ((before == 0xC3) & _LATIN_LETTER[last] & (cut - 2 >= w.starts))
    cut = cut[apart]
    starts, ends = np.sort(np.concatenate([w.starts, cut])), np.sort(np.concatenate([w.ends, cut]))
    bounds = np.searchsorted(starts, texts.bounds)
    return bytewords.Words(starts, ends, np.repeat(np.arange(texts.count), np.diff(bounds)), bounds)


class Encoder:
    """A tokenizer that lower-cases and drops white space, encoding each distinct piece of text once.

    Such a tokenizer never merges across a blank, nor from a letter to a sign behind it: a text's ids are those of
    its pieces in a row. Known pieces are found by a hash, sorted, and confirmed by a second hash; one array holds
    their ids, from which a text is gathered. Unknown words of the letters a-z go to the tokenizer's model as
    they are; others are encoded many at a time, with a mark between them. When more than ``CACHE_PIECES`` are
    known, the half that is used most stays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.keys, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.starts, self.lengths, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids = np.zeros(0, dtype=np.int32)

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of some pieces."""
        found: list[list[int]] = [[]] * len(pieces)
        marked = []
        tokenize, whole = self.tokenizer.model.tokenize, self.tokenizer.encode
        for i, p in enumerate(pieces):
            if p.isalpha():  # letters a-z alone are one word to the model, as they are
                found[i] = [token.id for token in tokenize(p.lower().decode())]
            elif b"<|" in p or b"\x01" in p or self.mark is None:  # special tokens' texts, the mark itself
                found[i] = whole(p.decode(), add_special_tokens=False).ids
            else:
                marked.append(i)
        for at in range(0, len(marked), _AT_ONCE):
            part = marked[at : at + _AT_ONCE]
            joined = b" \x01 ".join([pieces[i] for i in part]).decode()
            ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            cuts = [k for k, x in enumerate(ids) if x == self.mark]
            if len(cuts) != len(part) - 1:
                raise ValueError("the mark is not one id between blanks")
            for i, a, b in zip(part, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]):
                found[i] = ids[a:b]
        return found

    def _numbers(self, texts: bytewords.Texts, w: bytewords.Words) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, where its ids begin in ``self.ids``, and how many they are; learns the unknown."""
        keys, first, back, times = np.unique(
            bytewords.word_hashes(texts, w), return_index=True, return_inverse=True, return_counts=True
        )
        one = bytewords.Words(w.starts[first], w.ends[first], w.text[first], w.bounds)
        checks = bytewords.word_hashes(bytewords.Texts(0, texts.data ^ np.uint8(0xA5), texts.bounds), one)
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            hit = (self.keys[near] == keys) & (self.checks[near] == checks)
        self.uses[at[hit]] += times[hit]
        starts, lengths = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        starts[hit], lengths[hit] = self.starts[at[hit]], self.lengths[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            raw = texts.data.tobytes()
            ids = self._encoded([raw[a:b] for a, b in zip(one.starts[new].tolist(), one.ends[new].tolist())])
            lengths[new] = [len(x) for x in ids]
            starts[new] = len(self.ids) + np.cumsum(lengths[new]) - lengths[new]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), dtype=np.int32)])
            self.keys, self.checks = np.insert(self.keys, at[new], keys[new]), np.insert(self.checks, at[new], checks[new])
            self.starts, self.lengths = np.insert(self.starts, at[new], starts[new]), np.insert(self.lengths, at[new], lengths[new])
            self.uses = np.insert(self.uses, at[new], times[new])
        return starts[back], lengths[back]

    def _forget(self) -> None:
        """Leaves the half of the cache that is used most."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_PIECES // 2])
        self.keys, self.checks, self.uses = self.keys[stay], self.checks[stay], self.uses[stay] // 2
        self.ids = self.ids[_ranges(self.starts[stay], self.lengths[stay])]
        self.lengths = self.lengths[stay]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: bytewords.Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, in a row; and where each begins and the last ends."""
        # lower case makes fewer distinct pieces, but must not make a special token, nor a cut part one
        plain = b"<|" not in texts.data.tobytes()
        if plain:
            texts = bytewords.Texts(texts.first, bytewords.lowered(texts.data), texts.bounds)
        w = pieces_of(texts, signs_apart=plain)
        starts, lengths = self._numbers(texts, w)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        # one place more behind each text's last piece
        bounds = upto[w.bounds] + np.arange(texts.count + 1)
        out = np.full(bounds[-1], END_ID, dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[bounds[1:] - 1] = False
        out[body] = self.ids[_ranges(starts, lengths)]
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        return out, bounds


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given ranges, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


_ENCODERS: dict[str, Encoder] = {}
PART_BYTES = 256 << 20


def write_tokens(
    documents: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
    partitions: int | None = None,
) -> None:
    """Encodes each whole text, adds the end id, and writes (doc_id, ids, n, part, row).

    Texts are put in ranges of the key and sorted before they are encoded: they are smaller than
    their ids, and the sampling of the ranges does not encode anything. One part is one file. There are
    ``partitions`` of them: by default as many as Spark's shuffles have, or more where a part would hold
    over ``PART_BYTES`` of text.
    """
    rows = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if partitions is None:
        wanted = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
        if wanted > int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            partitions = wanted
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    kind = rows.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        for found in released(batches):
            for texts in bytewords.slices(found.column(1)):
                ids, bounds = encoder.encode(texts)
                values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([found.column(0).slice(texts.first, texts.count), values], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    made = (
        rows.sortWithinPartitions(*order)
        .mapInArrow(encode, schema)
        .withColumn("n", F.size("ids"))
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    with small_batches(documents.sparkSession):
        (
            made.write.option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", "0.01")
            .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
            .option("orc.stripe.size", str(STRIPE_BYTES))
            .option("orc.compress", "zstd")
            .orc(path)
        )


def read_tokens(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """The written rows: doc_id, ids, their number n, and the place in the order: part, row."""
    return spark.read.schema(f"doc_id {key_type}, ids array<int>, n int, part int, row bigint").orc(path)


def summaries(tokens: DataFrame) -> DataFrame:
    """From rows read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The ids are read once; what they add up to is kept, one narrow row each. A part adds up its own rows,
    and one row per part gives where it begins: no window holds more than a file's rows, or one row for each file.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
            bounds = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [rows.column("doc_id"), rows.column("part"), rows.column("row")]
            columns += [pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.mapInArrow(sums, f"doc_id {kind}, part int, row bigint, n_tokens bigint, ids_crc32 bigint")
    with small_batches(tokens.sparkSession):
        rows = durable(rows, "summaries")
    lengths = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begins = lengths.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inside = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(begins, "part")
    return rows.select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
