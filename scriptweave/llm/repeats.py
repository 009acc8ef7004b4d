"""Exact repeats of whole texts, as a suffix array finds them: a string of ``length`` bytes that starts
anywhere else too is removed wherever it stands.

Only equal neighbours of the suffix array matter, to a depth of ``length`` bytes, so it is built block by
block and never held whole. A difference cover picks some places of each text (9 of 73): whatever two
suffixes one compares, one of their next 73 places is picked in both. The picked suffixes are sorted first,
one bucket at a time. Their order is that of fingerprints made by prefix doubling, in which equal strings
have equal ranks. A picked place whose first 128 bytes stand nowhere else rules out every string through it.
The others have a rank for all that the strings through them can see (72 bytes before, 200 behind): where
that is equal too, the tie is long, and all strings through both places are repeats without being looked at.
What is left are strings near the edges of a repeat; of places with equal surroundings one speaks for all.
Those suffixes alone are sorted, again one bucket at a time, and neighbours of equal fingerprints are repeats.

Texts lie on shared storage in chunks of some megabytes. A bucket gets each distinct fingerprint of a chunk
once, so a passage that stands everywhere is no hot key, and answers with bits in the chunk's own order.
Fingerprints have 64 bits; two different strings meet by chance once in some 10^19 pairs.

Null and empty texts have no bytes and lose none; texts shorter than ``length`` are left alone. Repeated rows
are each other's repeats. A text is treated whole, whatever its length, in some 40 bytes of memory a byte.
Further columns are carried along; a result replaces a column of its name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.durable import durable
from . import bytewords

LENGTH = 200
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
# Places fingerprinted at once: few enough that the arrays stay near the processor.
_AT_ONCE = 1 << 16
_EIGHT = np.uint64(8)


@dataclass(frozen=True)
class Cover:
    """A difference cover: any two places have a common next place, less than ``period`` away, whose
    numbers modulo ``period`` are both in ``members``. Powers of two are one for the periods 7 and 73."""

    length: int
    period: int
    members: tuple[int, ...]

    @classmethod
    def of(cls, length: int) -> Cover:
        if length < 1:
            raise ValueError("a repeat has one byte or more")
        period = 73 if length >= 146 else 7 if length >= 14 else 1
        return cls(length, period, tuple(sorted({pow(2, k, period) for k in range(period)})))

    @property
    def seen(self) -> int:
        """Bytes from a common place on that two equal strings must share."""
        return self.length - self.period + 1


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bytewords.mix(a + b * np.uint64(0xC2B2AE3D27D4EB4F))


def prints(data: np.ndarray, *wanted: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Fingerprints of strings inside ``data``, given by where they start (ascending) and their lengths.

    Doubling: a string of a power of two is named by its halves, any other by the longest such strings at
    its beginning and end. All wanted strings are named in one pass.
    """
    outs = [np.zeros(len(starts), dtype=np.uint64) for starts, _ in wanted]
    every = [i for i, (starts, _) in enumerate(wanted) if len(starts)]
    if not every:
        return outs
    power = [(1 << np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1).astype(np.int64) for _, n in wanted]
    powers = np.unique(np.concatenate([np.unique(p) for p in power])).tolist()
    longest = max(int(wanted[i][1].max()) for i in every)
    begin, end = min(int(wanted[i][0][0]) for i in every), max(int(wanted[i][0][-1]) for i in every)
    for at in range(begin // _AT_ONCE * _AT_ONCE, end + 1, _AT_ONCE):
        cuts = [np.searchsorted(starts, [at, at + _AT_ONCE]).tolist() for starts, _ in wanted]
        if all(low == high for low, high in cuts):
            continue
        raw = level = bytewords.eights(data[at : at + _AT_ONCE + longest])
        size = 8
        for most in powers:
            if most >= 8 and level is raw:
                level = bytewords.mix(level)
            while size < most:
                half = np.zeros_like(level)
                half[: max(0, len(level) - size)] = level[size:]
                level = _joined(level, half)
                size *= 2
            for out, (starts, lengths), p, (low, high) in zip(outs, wanted, power, cuts):
                chosen = low + np.flatnonzero(p[low:high] == most)
                first, n = starts[chosen] - at, lengths[chosen]
                head, tail = level[first], level[first + n - most]
                if most < 8:
                    mask = np.uint64((1 << 8 * most) - 1)
                    head, tail = bytewords.mix(head & mask), bytewords.mix(tail & mask)
                out[chosen] = _joined(head, tail + n.astype(np.uint64))
    return outs


@dataclass
class Chunk:
    """Some texts in a row."""

    data: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Chunk:
        column = batch.column("_text").cast(pa.large_binary()).fill_null(b"")
        _, offsets, values = column.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
        return cls(data[bounds[0] : bounds[-1]], bounds - bounds[0])

    def picked(self, cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the cover through which a string of full length goes; begin and end of their texts."""
        sizes = np.diff(self.bounds)
        text = np.flatnonzero(sizes >= cover.length)
        places, first, last = [], [], []
        for member in cover.members:
            # members are 0 to period - 1 as numbers modulo the period
            count = (sizes[text] - cover.seen - member % cover.period) // cover.period + 1
            count = np.maximum(count, 0)
            which = np.repeat(text, count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            places.append(self.bounds[which] + member % cover.period + step * cover.period)
            first.append(self.bounds[which])
            last.append(self.bounds[which + 1])
        joined = np.concatenate(places)
        order = np.argsort(joined, kind="stable")
        return joined[order], np.concatenate(first)[order], np.concatenate(last)[order]


@dataclass
class Entries:
    """Distinct fingerprints of a chunk, by bucket: each one's first place, which stand more than once, and
    to which one each place belongs."""

    bucket: np.ndarray
    value: np.ndarray
    first: np.ndarray
    often: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, route: np.ndarray, value: np.ndarray, buckets: int) -> Entries:
        bucket = ((route & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(value)
        order = order[np.argsort(bucket[order].astype(np.min_scalar_type(buckets)), kind="stable")]
        b, v = bucket[order], value[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
        heads = np.flatnonzero(new)
        back = np.zeros(len(order), dtype=np.int64)
        back[order] = np.cumsum(new) - 1
        often = np.diff(np.append(heads, len(order))) > 1
        return cls(b[heads], v[heads], np.minimum.reduceat(order, heads) if len(heads) else heads, often, back)

    def rows(self, buckets: int) -> list[tuple[int, bytes, bytes]]:
        """(bucket, fingerprints, which stand more than once) of the buckets that have any."""
        cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))
        return [
            (k, self.value[a:b].tobytes(), np.packbits(self.often[a:b]).tobytes())
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            if b > a
        ]

    def bits(self, found: list[dict] | None, name: str) -> np.ndarray:
        """A bucket's answers, put in the order of the chunk's fingerprints; none means no."""
        out = np.zeros(len(self.value), dtype=bool)
        for row in found or []:
            a, b = np.searchsorted(self.bucket, [row["bucket"], row["bucket"] + 1])
            out[a:b] = np.unpackbits(np.frombuffer(row[name], dtype=np.uint8), count=b - a).astype(bool)
        return out


def covered_entries(chunk: Chunk, cover: Cover, buckets: int) -> tuple[Entries, np.ndarray, np.ndarray, np.ndarray]:
    """The picked places' fingerprints: half of a value for what two repeats through a place must share,
    half for all that strings through it see. Also the places, and begin and end of their texts."""
    places, first, last = chunk.picked(cover)
    left, right = np.maximum(places - cover.period + 1, first), np.minimum(places + cover.length, last)
    near, around = prints(chunk.data, (places, np.full(len(places), cover.seen)), (left, right - left))
    around = bytewords.mix(around * _EIGHT + (places - left).astype(np.uint64))
    value = (near >> np.uint64(32) << np.uint64(32)) | (around >> np.uint64(32))
    return Entries.of(near, value, buckets), places, first, last


def _spread(n: int, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, behind, -1)
    return np.cumsum(change[:-1]) > 0


def _strings_through(chunk: Chunk, cover: Cover, places: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a string of full length that goes through one of the places begins here."""
    low = np.maximum(places - cover.period + 1, first)
    high = np.minimum(places, last - cover.length) + 1
    some = high > low
    return _spread(len(chunk.data), low[some], high[some])


def edge_entries(
    chunk: Chunk, cover: Cover, covered: tuple[Entries, np.ndarray, np.ndarray, np.ndarray], speaks: np.ndarray, buckets: int
) -> tuple[Entries, np.ndarray]:
    """Fingerprints of all strings through the places that speak, and where the strings begin."""
    entries, places, first, last = covered
    at = np.sort(entries.first[speaks])
    starts = np.flatnonzero(_strings_through(chunk, cover, places[at], first[at], last[at]))
    [value] = prints(chunk.data, (starts, np.full(len(starts), cover.length)))
    return Entries.of(value, value, buckets), starts


def removed(
    chunk: Chunk, cover: Cover, covered: tuple[Entries, np.ndarray, np.ndarray, np.ndarray], same: np.ndarray, starts: np.ndarray
) -> np.ndarray:
    """Which bytes a repeat covers: strings through places with equal surroundings, and those at ``starts``."""
    entries, places, first, last = covered
    at = np.flatnonzero(same[entries.back])
    begins = _strings_through(chunk, cover, places[at], first[at], last[at])
    begins[starts] = True
    found = np.flatnonzero(begins)
    return _spread(len(chunk.data), found, found + cover.length)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fingerprints of a bucket, how often they stand (2: or more), and the row each is of."""
    values = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("entries")]
    sizes = [len(v) for v in values]
    often = [np.unpackbits(np.frombuffer(x.as_buffer(), dtype=np.uint8), count=n) for x, n in zip(table.column("often"), sizes)]
    return np.concatenate(values), 1 + np.concatenate(often).astype(np.int64), np.array(sizes)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.cumsum(new) - 1


def _answers(table: pa.Table, sizes: np.ndarray, bits: dict[str, np.ndarray]) -> pa.Table:
    """One row for each chunk that gets any answer but no."""
    ends = np.cumsum(sizes)
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
    rows = []
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        if any(x[a:b].any() for x in bits.values()):
            rows.append((chunks[i], int(list(bits.values())[-1][a:b].sum()), [np.packbits(x[a:b]).tobytes() for x in bits.values()]))
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64())]
    columns += [pa.array([r[2][k] for r in rows], pa.binary()) for k in range(len(bits))]
    return pa.table(columns, names=["chunk", "bucket", "n", *bits])


def _ranked_cover(table: pa.Table) -> pa.Table:
    """Sorts a bucket of the cover. ``same``: the surroundings stand elsewhere too; ``speaks``: the place is
    the first of its surroundings, and others share its string but not its surroundings."""
    values, times, sizes = _unpacked(table)
    order = np.argsort(values, kind="stable")
    in_order = values[order]
    full, near = _runs(in_order), _runs(in_order >> np.uint64(32))
    same = np.bincount(full, weights=times[order])[full] > 1
    # kinds of surroundings among the places that share a string
    kinds = np.zeros(near[-1] + 1, dtype=np.int64)
    heads = np.ones(len(full), dtype=bool)
    heads[1:] = full[1:] != full[:-1]
    np.add.at(kinds, near[heads], 1)
    speaks = heads & (kinds[near] > 1)
    out = {name: np.zeros(len(values), dtype=bool) for name in ("same", "speaks")}
    out["same"][order], out["speaks"][order] = same, speaks
    return _answers(table, sizes, out)


def _ranked_edges(table: pa.Table) -> pa.Table:
    """Sorts a bucket of the strings near edges: which stand elsewhere too."""
    values, times, sizes = _unpacked(table)
    order = np.argsort(values, kind="stable")
    run = _runs(values[order])
    out = np.zeros(len(values), dtype=bool)
    out[order] = np.bincount(run, weights=times[order])[run] > 1
    return _answers(table, sizes, {"repeated": out})


_SENT = "chunk long, bucket int, entries binary, often binary"


def _sent(chunk: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32())]
    columns += [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "entries", "often"])


def _chunks(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(chunk, n_bytes, rows): the texts and carried columns in Arrow's own form, a chunk a row."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for texts in bytewords.slices(batch.column("_text"), size=CHUNK_BYTES):
                part, sink = batch.slice(texts.first, texts.count), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_batch(part)
                columns = [pa.array([len(texts.data)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["n_bytes", "rows"])

    rows = documents.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    made = rows.mapInArrow(packed, "n_bytes long, rows binary")
    return durable(made.select(F.monotonically_increasing_id().alias("chunk"), "n_bytes", "rows"), "chunks")


def _rows_of(packed) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _buckets(places: int) -> int:
    return max(1, -(-8 * places // BUCKET_BYTES))


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    """The answers of all buckets by chunk."""
    fields = [c for c in answers.columns if c not in ("chunk", "n")]
    return answers.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(name))


def without_repeats(documents: DataFrame, length: int = LENGTH, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, spans (byte offsets [from, to) of maximal removed runs) and kept (the
    other bytes) to each document. ``keep`` names the columns to carry (default: all)."""
    results = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in results]
    cover = Cover.of(length)
    chunks = _chunks(documents, text, keep)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = _buckets(total * len(cover.members) // cover.period)

    def send_cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                entries, *_ = covered_entries(Chunk.of(_rows_of(packed)), cover, buckets)
                yield _sent(number, entries.rows(buckets))

    sent = chunks.select("chunk", "rows").mapInArrow(send_cover, _SENT)
    ranked = sent.groupBy("bucket").applyInArrow(_ranked_cover, "chunk long, bucket int, n long, same binary, speaks binary")
    ranked = durable(ranked, "cover")
    speaking = ranked.agg(F.sum("n")).first()[0] or 0
    edge_buckets = _buckets(speaking * cover.period)
    by_chunk = _gathered(ranked, "cover").hint("shuffle_hash")

    def send_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, packed, found in zip(batch.column("chunk").to_pylist(), batch.column("rows"), batch.column("cover")):
                found = found.as_py()
                chunk = Chunk.of(_rows_of(packed))
                covered = covered_entries(chunk, cover, buckets)
                entries, _ = edge_entries(chunk, cover, covered, covered[0].bits(found, "speaks"), edge_buckets)
                yield _sent(number, entries.rows(edge_buckets))

    # a chunk without any answer has no string to send
    sent = chunks.select("chunk", "rows").join(by_chunk, "chunk").mapInArrow(send_edges, _SENT)
    edges = sent.groupBy("bucket").applyInArrow(_ranked_edges, "chunk long, bucket int, n long, repeated binary")
    edges = durable(edges, "edges")
    found = by_chunk.join(_gathered(edges, "edges"), "chunk", "left").hint("shuffle_hash")
    kinds = [documents.schema[c] for c in keep]
    names = [f"_{i}" for i in range(len(keep))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, kinds)]
    fields += [T.StructField(f"_{c}", T.LongType()) for c in results[:3]]
    fields += [T.StructField("_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_kept", T.BinaryType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, ranks, tied in zip(batch.column("rows"), batch.column("cover"), batch.column("edges")):
                rows = _rows_of(packed)
                chunk = Chunk.of(rows)
                gone = np.zeros(len(chunk.data), dtype=bool)
                ranks, tied = ranks.as_py(), tied.as_py()
                if ranks:
                    covered = covered_entries(chunk, cover, buckets)
                    entries, starts = edge_entries(chunk, cover, covered, covered[0].bits(ranks, "speaks"), edge_buckets)
                    again = starts[entries.bits(tied, "repeated")[entries.back]]
                    gone = removed(chunk, cover, covered, covered[0].bits(ranks, "same"), again)
                columns = [rows.column(n) for n in names]
                columns += _cut_columns(chunk, gone)
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    rows = chunks.select("chunk", "rows").join(found, "chunk", "left").mapInArrow(cut, T.StructType(fields))
    return rows.toDF(*keep, *results)


def _cut_columns(chunk: Chunk, gone: np.ndarray) -> list[pa.Array]:
    """The result columns of a chunk, given which bytes go."""
    bounds, n = chunk.bounds, len(chunk.data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = gone[:-1]
    begins = np.flatnonzero(gone & (~before | edge[:n]))
    behind = np.zeros(n, dtype=bool)
    behind[: n - 1] = gone[1:]
    ends = np.flatnonzero(gone & (~behind | edge[1:])) + 1
    which = np.searchsorted(begins, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(which))
    pairs = np.stack([begins - bounds[text], ends - bounds[text]], axis=1).ravel()
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2), pa.int32()), pa.array(pairs, pa.int64()))
    spans = pa.ListArray.from_arrays(pa.array(which, pa.int32()), inner)
    dropped = bytewords.per_text(gone, bounds)
    stay = chunk.data[~gone].tobytes()
    cuts = np.concatenate([[0], np.cumsum(np.diff(bounds) - dropped)]).tolist()
    kept = [stay[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    counts = [np.diff(bounds), dropped, np.diff(which)]
    return [*[pa.array(c.astype(np.int64)) for c in counts], spans, pa.array(kept, pa.binary())]


def oracle(length: int = LENGTH) -> str:
    """The same in SQL, for the digest columns: every string of every text is grouped."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT rid, unnest(range(0, CAST(length(h) // 2 - {length - 1} AS BIGINT), 500)) AS base, length(h) // 2 - {length} AS most, h FROM d
      WHERE length(h) >= {2 * length}),
e AS (SELECT rid, base, most, substr(h, 2 * base + 1, {2 * length + 998}) AS h FROM c),
s AS (SELECT rid, base, unnest(range(0, CAST(least(500, most - base + 1) AS BIGINT))) AS o, h FROM e),
k AS (SELECT rid, base + o AS i, md5_number(substr(h, 2 * o + 1, {2 * length})) AS k FROM s),
r AS (SELECT rid, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM g),
p AS (SELECT rid, min(i) AS a, max(i) + {length} AS b FROM n GROUP BY rid, run),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM p),
t AS (SELECT q.rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS rest
      FROM q JOIN d ON d.rid = q.rid GROUP BY q.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.rid = d.rid"""
