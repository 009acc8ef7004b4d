"""Fuzzy line deduplication by MinHash.

A line is its characters, lower-cased and with runs of white space as one blank; equal lines are one
class. Lines of at least ``MIN_BYTES`` are sets of runs of eight bytes, with a MinHash signature of one
byte for each of 60 places. Bands of five find candidates (of pairs at 0.8, 99 in 100; at 0.9,
all but one in 50,000), signatures drop hopeless ones, full sets confirm, and a distributed union-find
joins them. Of each component the first line, by document id and line number, stays; the others go.

Lines of fewer than ``min_bytes`` bytes, among them blank ones, are left alone by default: they repeat by chance.
With 0, blank lines alone are. Null texts stay null and empty ones empty. Every row is a document of its own,
also where rows share an id or have none; null ids come last, and rows of one id are in order of their texts.
Further columns are carried along; n_lines and n_dropped replace columns of their names.

The rows are written once, bucketed by blocks of rows, and no text is shuffled: lines go by 128 bits of their content
and by their place, and what is found about lines (which to sign, to compare, to drop) goes to the rows' buckets. Only
candidates' texts move, and their sets are made where they are compared.

One hash of a run gives its place in the signature and its value there (one-permutation hashing). A place that no run of
a line falls to takes the least of a permutation of its own, so that each place of two signatures still agrees with
the chance that the sets' likeness is, for lines of any length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.durable import durable, new_path
from . import bytewords
from .memory import released, small_batches
from .near import Members, bucket_components, packed_buckets

SHINGLE, MIN_BYTES, PERCENT = 8, 20, 80
# Buckets of so many lines have all pairs of signatures judged.
SMALL = 64
# Lines taken at once: few enough that the arrays stay near the processor.
SLICE_BYTES = 1 << 16
BANDS, PER_BAND = 12, 5
REGISTERS = BANDS * PER_BAND
# Rows of a block: what is found about a block's lines meets its rows as one value.
BLOCK_ROWS = 2048
# Shorter lines, which leave many places open, are taken through all permutations.
_SHORT = 2 * REGISTERS
_OPEN = np.uint32(0xFFFFFFFF)
_SALTS = bytewords.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).astype(np.uint32)
_ODD = bytewords.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_BLANK, _NEWLINE = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _BLANK
_KIND[0x0A] = _NEWLINE


def runs(texts: bytewords.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of eight bytes of each line, repeats kept, and bounds; a shorter line is one run."""
    lengths = np.diff(texts.bounds)
    code = bytewords.eights(texts.data)
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    code[texts.bounds[short]] &= (np.uint64(1) << (lengths[short] * 8).astype(np.uint64)) - np.uint64(1)
    counts = np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(bounds[-1]) + np.repeat(texts.bounds[:-1] - bounds[:-1], counts)
    return bytewords.mix(code[at]), bounds


def shingler(texts: bytewords.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of eight bytes of each line; a shorter line is one run."""
    codes, bounds = runs(texts)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        codes[a:b].sort()
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    return codes[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signature(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One byte for each place of the lines' signatures, all zero without codes; codes may be repeated."""
    count, lengths = len(bounds) - 1, np.diff(bounds)
    place = ((codes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(count * REGISTERS, _OPEN, dtype=np.uint32)
    np.minimum.at(least, np.repeat(np.arange(count) * REGISTERS, lengths) + place.astype(np.int64), codes.astype(np.uint32))
    least = least.reshape(count, REGISTERS)
    # the codes are mixed, so half of one, times an odd number, is a permutation of 32 bits that serves
    half = (codes >> np.uint64(32)).astype(np.uint32)
    short = (lengths > 0) & (lengths < _SHORT)
    if short.any():
        part = half[np.repeat(short, lengths)]
        starts = np.concatenate([[0], np.cumsum(lengths[short])[:-1]])
        own, work = np.empty((REGISTERS, len(starts)), dtype=np.uint32), np.empty_like(part)
        for k in range(REGISTERS):
            np.multiply(np.bitwise_xor(part, _SALTS[k], out=work), _ODD[k], out=work)
            np.minimum.reduceat(work, starts, out=own[k])
        least[short] = np.where(least[short] == _OPEN, own.T, least[short])
    line, k = np.nonzero((least == _OPEN) & (lengths >= _SHORT)[:, None])
    if len(line):
        starts = np.concatenate([[0], np.cumsum(lengths[line])])
        work = half[np.arange(starts[-1]) + np.repeat(bounds[line] - starts[:-1], lengths[line])]
        work ^= np.repeat(_SALTS[k], lengths[line])
        work *= np.repeat(_ODD[k], lengths[line])
        least[line, k] = np.minimum.reduceat(work, starts[:-1])
    out = (bytewords.mix(least.astype(np.uint64) + np.uint64(1)) & np.uint64(255)).astype(np.uint8)
    out[lengths == 0] = 0
    return out


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may be alike to the percentage: five standard deviations are left."""
    wanted = percent / 100 + (1 - percent / 100) / 256
    return (a == b).mean(axis=1) >= wanted - 5 * np.sqrt(wanted * (1 - wanted) / a.shape[1])


def _picked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> bytewords.Texts:
    """The lines of the given numbers, in that order, one behind the other."""
    lengths = ends[which] - starts[which]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return bytewords.Texts(0, data[np.arange(bounds[-1]) + np.repeat(starts[which] - bounds[:-1], lengths)], bounds)


def normalised(texts: bytewords.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts that end in a newline each: bytes, first and last bounds of the normalised lines, the
    lines' bytes as they were, and the number of each text's first line (one more at the end)."""
    data, kind = texts.data, _KIND[texts.data]
    ends = np.flatnonzero(kind == _NEWLINE)
    raw = np.diff(ends, prepend=-1) - 1
    first = np.searchsorted(ends, texts.bounds)
    blank = kind == _BLANK
    if blank.any():
        again = blank.copy()
        again[1:] &= kind[:-1] != 0
        if again.any():
            data, kind = data[~again], kind[~again]
        trailing = kind == _BLANK
        trailing[:-1] &= kind[1:] == _NEWLINE
        if trailing.any():
            data, kind = data[~trailing], kind[~trailing]
        data = np.where(kind == _BLANK, np.uint8(0x20), data)
        ends = np.flatnonzero(kind == _NEWLINE)
    starts = np.concatenate([[0], ends + 1])[: len(ends)]
    return data, starts, ends, raw, first


def _lowered(text: str) -> Column:
    """The text in lower case, with a newline behind its last line."""
    return F.concat(F.lower(text), F.lit("\n"))


def _raw_lengths(text: str) -> Column:
    """The lines' bytes, where lower case may change them."""
    changed = F.octet_length(text) != F.octet_length(F.lower(text))
    return F.when(changed, F.transform(F.split(text, "\n"), lambda x: F.octet_length(x)))


def _lines(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(row, line_no, place, hi, lo, registers): the lines of rows (row, place, text) that are compared, 128 bits of each,
    and its signature, which is null where a line stands again among those taken at once."""
    least = max(1, min_bytes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for texts in bytewords.slices(batch.column("text"), size=SLICE_BYTES):
                data, starts, ends, raw, first = normalised(texts)
                own = batch.column("raw").slice(texts.first, texts.count)
                if own.null_count < len(own):
                    for i in np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)):
                        raw[first[i] : first[i + 1]] = own[i].as_py()
                which = np.flatnonzero((ends - starts >= least) & (raw >= least))
                whole = data.tobytes()
                digests = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(starts[which].tolist(), ends[which].tolist())]
                new = dict(zip(reversed(digests), reversed(range(len(digests)))))
                new = np.sort(np.fromiter(new.values(), np.int64, len(new)))
                signed = signature(*runs(_picked(data, starts, ends, which[new])))
                signs = np.zeros(len(which), dtype=np.int64)
                signs[new] = REGISTERS
                bounds = np.concatenate([[0], np.cumsum(signs)]).astype(np.int32)
                mask = pa.array(signs > 0)
                registers = pa.BinaryArray.from_buffers(
                    pa.binary(), len(which), [mask.buffers()[1], pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(signed))]
                )
                digests = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                text = np.searchsorted(first, which, side="right") - 1
                part = batch.slice(texts.first, texts.count).take(pa.array(text))
                columns = [part.column("row"), pa.array((which - first[text]).astype(np.int32)), part.column("place")]
                columns += [pa.array(digests[:, k].copy()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, registers], names=names)

    names = ["row", "line_no", "place", "hi", "lo", "registers"]
    types = [T.LongType(), T.IntegerType(), rows.schema["place"].dataType, T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(*x) for x in zip(names, types)])
    rows = rows.filter(F.col("text").isNotNull())
    return rows.select("row", "place", _lowered("text").alias("text"), _raw_lengths("text").alias("raw")).mapInArrow(found, schema)


def bucketed(rows: DataFrame) -> DataFrame:
    """The rows, numbered (row) and kept on shared storage in buckets of blocks of rows; nothing is shuffled."""
    spark = rows.sparkSession
    table = f"rows_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("block", _block())
    writer = rows.write.bucketBy(buckets, "block").option("path", new_path(spark, "rows")).option("compression", "zstd")
    writer.format("parquet").saveAsTable(table)
    return spark.read.table(table)


def _block() -> Column:
    return F.shiftright("row", BLOCK_ROWS.bit_length() - 1)


def with_marks(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The bucketed rows with what ``marks`` (row, mark) says of each (array, null without any) as ``marks``: marks go
    to the rows' buckets. An inner join may leave out rows without marks."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = marks.withColumn("block", _block()).repartition(buckets, "block")
    marks = marks.groupBy("block", "row").agg(F.collect_list("mark").alias("marks"))
    marks = marks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("row", "marks"))).alias("by_row"))
    rows = rows.join(marks.hint("shuffle_hash"), "block", how)
    return rows.withColumn("marks", F.try_element_at("by_row", F.col("row"))).drop("by_row")


def _of_lines(
    rows: DataFrame, wanted: DataFrame, made: Callable[[pa.Array, bytewords.Texts], list[pa.Array]], schema: str
) -> DataFrame:
    """What is made of the ids and normalised texts of the lines that ``wanted`` (id, row, line_no) names."""
    names = T.StructType.fromDDL(schema).names

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for texts in bytewords.slices(batch.column("text"), size=SLICE_BYTES):
                data, starts, ends, _, first = normalised(texts)
                marks = batch.column("marks").slice(texts.first, texts.count)
                counts = marks.value_lengths().to_numpy()
                marks = marks.flatten()
                which = np.repeat(first[:-1], counts) + marks.field("line_no").to_numpy()
                order = np.argsort(which, kind="stable")
                lines = _picked(data, starts, ends, which[order])
                yield pa.RecordBatch.from_arrays(made(marks.field("id").take(pa.array(order)), lines), names=names)

    marks = wanted.select("row", F.struct("line_no", "id").alias("mark"))
    marked = with_marks(rows.select("block", "row", "text"), marks, "inner").filter(F.col("marks").isNotNull())
    return marked.select(_lowered("text").alias("text"), "marks").mapInArrow(found, schema)


def _texts(ids: pa.Array, lines: bytewords.Texts) -> list[pa.Array]:
    whole = lines.data.tobytes()
    return [ids, pa.array([whole[a:b] for a, b in zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist())], pa.binary())]


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The codes of lines that were stored as texts."""
    out = []
    for texts in bytewords.slices(column.cast(pa.large_binary()).cast(pa.large_string()), size=SLICE_BYTES):
        codes, bounds = shingler(texts)
        out += [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def line_classes(rows: DataFrame, lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(hi, lo, keep) of bucketed rows and their lines: the lines that some other line is like, or stands again, and
    the place (row, line_no) of the one that stays."""
    place = F.struct("place", "row", "line_no")
    distinct = lines.groupBy("hi", "lo").agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("lines"), F.first("registers", ignorenulls=True).alias("registers")
    )
    distinct = durable(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    buckets = durable(packed_buckets(distinct, BANDS, PER_BAND), "buckets")
    # of the lines with company all is kept, so that the others are passed over once
    classes = durable(Members(buckets, "id").among(distinct, "id"), "candidates")

    def sets_of(wanted: DataFrame) -> DataFrame:
        asked = classes.select("id", "place.row", "place.line_no").join(wanted.select("id").distinct(), "id")
        return _of_lines(rows, asked, _texts, "id long, codes binary")

    found = bucket_components(buckets, classes.select("id", "registers"), sets_of, _sets, possible, percent, SMALL)
    found = durable(found.withColumnRenamed("node", "id"), "components")
    distinct = distinct.drop("registers")
    linked = classes.select(distinct.columns).join(found, "id")
    alone = distinct.filter("lines > 1").join(found, "id", "left_anti").withColumn("component", F.col("id"))
    named = durable(linked.unionByName(alone), "named")
    keep = named.groupBy("component").agg(F.min("place").alias("keep"), F.sum("lines").alias("all_lines")).filter("all_lines > 1")
    kept = named.select("hi", "lo", "component").join(keep, "component")
    return durable(kept.select("hi", "lo", F.struct("keep.row", "keep.line_no").alias("keep")), "kept")


def _line_count(text: Column) -> Column:
    """Its lines, counted without cutting the text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of the given numbers."""

    def left(parts: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(numbers, lambda i: parts[i]), "\n")

    # the parts are a variable, so that the text is split once and not for each line
    return F.transform(F.array(F.split(text, "\n")), left)[0]


def deduplicated(
    documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_bytes: int = MIN_BYTES
) -> DataFrame:
    """The documents, with their text reduced to the lines that stay, and n_lines and n_dropped added.

    The rows are written once under numbers of their own; lines' places are narrow.
    """
    with small_batches(documents.sparkSession):
        return _deduplicated(documents, key, text, percent, min_bytes)


def _deduplicated(documents: DataFrame, key: str, text: str, percent: int, min_bytes: int) -> DataFrame:
    others = [c for c in documents.columns if c != text and c.lower() not in ("n_lines", "n_dropped")]
    place = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("hash"))
    rows = bucketed(documents.select(
        place.alias("place"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)],
    ))
    lines = durable(_lines(rows, min_bytes), "lines")
    classes = line_classes(rows, lines, percent)
    narrow = Members(classes, "hi").among(lines.select("hi", "lo", "row", "line_no"), "hi")
    dropped = narrow.join(classes, ["hi", "lo"]).filter(F.struct("row", "line_no") != F.col("keep"))
    drops = durable(dropped.select("row", F.col("line_no").alias("mark")), "drops")
    rows = with_marks(rows, drops, "left")
    return rows.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)],
        F.when(F.col("marks").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("marks"))).alias(text),
        F.coalesce(_line_count(F.col("text")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("marks"), F.lit(0)).cast("long").alias("n_dropped"),
    )
