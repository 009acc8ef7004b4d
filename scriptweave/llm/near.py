"""Near-duplicate classes: banded signatures, likelihood, exact check, components.

Items with equal sets are one class first. Signatures of the classes are cut into bands; classes that
agree in a band share a bucket. In each bucket all others are compared with one centre, the class with
most company, so a bucket of thousands makes thousands of pairs, not millions. Pairs whose signatures
rule the threshold out are dropped, the rest is checked on full sets, and links become components.

What is left are buckets with several components, in which two members that both differ from the centre
may still be alike. Chance brings more strangers into a bucket the more classes there are, so members are
put together by signatures that do not rule a link out, not by buckets: strangers would make one cluster of
most classes. A class of which too many shingles stand in no other such class can have no link and
is dropped. The rest is compared in full, in blocks of bounded size, each pair of blocks apart from the others;
pairs inside one component need no comparison. So no link that shares a bucket is lost, but by signatures
that rule it out.

Where buckets of few members are told apart (``small``), all pairs of signatures in them are judged at once, those of
the member with most likely pairs are checked first, and of the others those between different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable
from . import bytewords
from .components import components
from .memory import released

# A block of the full comparison: at most about so many classes and shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000
# Members of small buckets that are judged together, and pairs of them at once.
JUDGED_ROWS, JUDGED_PAIRS = 1 << 14, 1 << 14
# Members of mixed buckets that are judged together, those of a bucket whose pairs are judged one and all, and places
# of a larger one looked at once.
MIXED_ROWS, MIXED_SMALL, MIXED_PLACES = 1 << 12, 64, 1 << 22
# Pairs and shingles that a task of the full comparison takes, about.
TASK_PAIRS, TASK_SHINGLES = 1 << 19, 1 << 21
_VOCABULARY = 4096
# Codes of bands sorted at once, and those that a task keeps until it deals them out.
PART_CODES, HELD_CODES = 1 << 18, 1 << 20

# Bits of a membership filter: some sixteen for each value, so that few others pass, and at most 2^30 (128 MB).
# Beyond a hundred million values it lets more pass; the exact join behind it decides either way.
LEAST_BITS, MOST_BITS = 16, 30

#: Codes (sorted and distinct in each text) of some texts, and their bounds by text.
Shingler = Callable[[bytewords.Texts], tuple[np.ndarray, np.ndarray]]
#: Codes (sorted and distinct) of each value of a column of sets.
Unpacker = Callable[[pa.Array], list[np.ndarray]]
#: Registers (texts x places) of code sets.
Signer = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Whether pairs (registers a, registers b, sizes a, sizes b) may reach the percentage.
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def distinct_codes(codes: np.ndarray, text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of each text, and bounds."""
    order = np.argsort(codes)
    order = order[np.argsort(text[order].astype(np.min_scalar_type(max(1, count))), kind="stable")]
    codes, text = codes[order], text[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    codes, text = codes[new], text[new]
    return codes, np.searchsorted(text, np.arange(count + 1))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


class Members:
    """A filter that lets all wanted values pass, and others only by chance; its size is made for their number."""

    def __init__(self, wanted: DataFrame, name: str):
        self.size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * wanted.count()).bit_length()))
        slot = F.xxhash64(name).bitwiseAND(self.size - 1)
        # a byte of the filter at a time, put together by the tasks
        parts = wanted.select(F.shiftright(slot, 3).alias("byte"), F.call_function("shiftright", F.lit(128), slot.bitwiseAND(7).cast("int")).alias("bit"))
        found = parts.groupBy("byte").agg(F.bit_or("bit").cast("short").alias("bits")).toArrow()
        bits = np.zeros(self.size >> 3, dtype=np.uint8)
        bits[found.column("byte").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
        self.shared = wanted.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self):
        return {"shared": self.shared, "size": self.size}

    def among(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows whose value may be wanted."""
        schema = rows.schema

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                yield batch.filter(pa.array(self.passes(batch.column("_slot").to_numpy()))).select(schema.names)

        return rows.withColumn("_slot", F.xxhash64(name)).mapInArrow(kept, schema)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & (self.size - 1)
        return (self.shared.value[slot >> 3] >> (7 - (slot & 7))) & 1 == 1


def signatures(items: DataFrame, shingler: Shingler, signer: Signer, size: int = bytewords.SLICE_BYTES) -> DataFrame:
    """(id, n, fp1, fp2, registers) of items (id, text): two sums of codes tell equal sets. A column ``key``
    is carried along."""
    carried = [c for c in ("key", "id") if c in items.columns]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for texts in bytewords.slices(batch.column("text"), lower=True, size=size):
                codes, bounds = shingler(texts)
                prints = []
                for salt in (0x1234567, 0x89ABCDEF):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(bytewords.mix(codes + np.uint64(salt)), dtype=np.uint64)])
                    prints.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                part = batch.slice(texts.first, texts.count)
                columns = [*[part.column(c) for c in carried], pa.array(np.diff(bounds).astype(np.int64)), pa.array(prints[0]), pa.array(prints[1])]
                yield pa.RecordBatch.from_arrays([*columns, _binary(signer(codes, bounds))], names=[*carried, "n", "fp1", "fp2", "registers"])

    schema = ", ".join(f"{c} long" for c in [*carried, "n", "fp1", "fp2"])
    return items.select(*carried, "text").mapInArrow(rows, f"{schema}, registers binary")


def _band_codes(batch: pa.RecordBatch, bands: int, per_band: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of every band of every class (id, registers), and the classes' ids."""
    registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
    code = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (batch.num_rows, 1))
    for k in range(per_band):
        code = bytewords.mix(code * np.uint64(31) + registers[:, k : bands * per_band : per_band].astype(np.uint64))
    return code.ravel(), np.repeat(batch.column("id").to_numpy(), bands)


def _banded(classes: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(bucket, id) for every band of every class."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            code, ids = _band_codes(batch, bands, per_band)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "registers").mapInArrow(rows, "bucket long, id long")


def packed_buckets(classes: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(bucket, id, members) of the buckets that several of the classes (id, registers) share.

    For many small classes: codes are dealt out by value as packed arrays, twelve bytes for a band, and sorted
    part by part. A part has some ``PART_CODES`` codes, of which 32 bits are kept; where those of two bands meet
    by chance, they share a bucket.
    """
    parts = max(1, -(-classes.count() * bands // PART_CODES))

    def dealt(codes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        code, owner = np.concatenate(codes), np.concatenate(ids)
        part = (code >> np.uint64(32)) % np.uint64(parts)
        # few parts are sorted as short numbers, by radix
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
        code, owner, part = code[order].astype(np.uint32), owner[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = [*starts[1:], len(part)]
        packed = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (code, owner)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), *packed], names=["part", "codes", "ids"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ids, held = [], [], 0
        for batch in released(batches):
            if batch.num_rows:
                code, owner = _band_codes(batch, bands, per_band)
                codes, ids, held = [*codes, code], [*ids, owner], held + len(code)
            if held >= HELD_CODES:
                yield dealt(codes, ids)
                codes, ids, held = [], [], 0
        if held:
            yield dealt(codes, ids)

    def shared(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py() if table.num_rows else 0
        code, owner = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("codes", np.uint32), ("ids", np.int64)))
        order = np.argsort(code)
        code, owner = code[order], owner[order]
        bounds = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)
        times = np.repeat(np.diff(bounds), np.diff(bounds))
        keep = times > 1
        bucket = code[keep].astype(np.int64) + (part << 32)
        return pa.table({"bucket": bucket, "id": owner[keep], "members": times[keep].astype(np.int64)})

    made = classes.select("id", "registers").mapInArrow(rows, "part long, codes binary, ids binary")
    return made.groupBy("part").applyInArrow(shared, "bucket long, id long, members long")


def _with_sizes(classes: DataFrame) -> DataFrame:
    """The classes, with one size (n) for all where none is known."""
    return classes if "n" in classes.columns else classes.withColumn("n", F.lit(1).cast("long"))


def _likely(pairs: DataFrame, classes: DataFrame, judge: Judge, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out. Sizes rule pairs out where the classes have them (n)."""
    classes = _with_sizes(classes)
    for side in "ab":
        named = classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("registers").alias(f"r{side}"))
        pairs = pairs.join(named, side)
    low = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("ra", "rb")
            )
            likely = judge(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    return pairs.filter(low).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(rows, "a long, b long")


def _sets(items: DataFrame, wanted: DataFrame, shingler: Shingler) -> DataFrame:
    """(id, n, codes) of the wanted items: the texts are filtered where they lie, only sets move."""
    members = Members(wanted, "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            kept = batch.filter(pa.array(members.passes(batch.column("slot").to_numpy())))
            for texts in bytewords.slices(kept.column("text"), lower=True):
                codes, bounds = shingler(texts)
                packed = [codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                part = kept.slice(texts.first, texts.count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(packed, pa.binary())], names=["id", "n", "codes"]
                )

    made = items.select("id", "text", F.xxhash64("id").alias("slot")).mapInArrow(rows, "id long, n long, codes binary")
    return made.join(wanted.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _stored(column: pa.Array) -> list[np.ndarray]:
    """Codes that were stored as they are."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _confirmed(pairs: DataFrame, sets: DataFrame, unpacked: Unpacker, percent: int) -> DataFrame:
    """The pairs (a, b) as links (u, v) whose full sets reach the percentage."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("codes").alias(f"c{side}")), side)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keep = []
            for at in range(0, batch.num_rows, BLOCK_CLASSES):
                part = batch.slice(at, BLOCK_CLASSES)
                for a, b in zip(unpacked(part.column("ca")), unpacked(part.column("cb"))):
                    near = 100 * min(len(a), len(b)) >= percent * max(len(a), len(b))
                    n = _common(a, b) if near else 0
                    keep.append(near and 100 * n >= percent * (len(a) + len(b) - n))
            found = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=["u", "v"])

    return pairs.select("a", "b", "ca", "cb").mapInArrow(rows, "u long, v long")


def _incidence(codes: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Which of the codes ``vocabulary`` each set has."""
    out = np.zeros((len(codes), len(vocabulary)), dtype=np.float32)
    for i, found in enumerate(codes):
        low, high = np.searchsorted(found, vocabulary[0]), np.searchsorted(found, vocabulary[-1], side="right")
        at = np.searchsorted(vocabulary, found[low:high])
        hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == found[low:high]
        out[i, at[hit]] = 1
    return out


def links_between(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each set of ``a`` and each of ``b`` reach the percentage; a block at a time in memory."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    codes, times = np.unique(np.concatenate([*a, *b]), return_counts=True)
    codes = codes[times > 1]
    common = np.zeros((len(a), len(b)), dtype=np.float64)
    for at in range(0, len(codes), _VOCABULARY):
        part = codes[at : at + _VOCABULARY]
        common += _incidence(a, part) @ _incidence(b, part).T
    return 100 * common >= percent * (na[:, None] + nb[None, :] - common)


def _block_links(rows: DataFrame, unpacked: Unpacker, percent: int) -> DataFrame:
    """Links between different components inside each pair of blocks (cluster, first, second)."""

    def links(table: pa.Table) -> pa.Table:
        first = table.column("first")[0].as_py() if table.num_rows else 0
        second = table.column("second")[0].as_py() if table.num_rows else 0
        block = table.column("block").to_numpy()
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy()
        codes = unpacked(table.column("codes"))
        i, j = np.flatnonzero(block == first), np.flatnonzero(block == second)
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(i) and len(j):
            # one link between two components is enough
            hit = links_between([codes[k] for k in i], [codes[k] for k in j], percent) & (comp[i][:, None] != comp[j][None, :])
            x, y = np.nonzero(hit)
            pairs = np.stack([comp[i][x], comp[j][y]], axis=1)
            _, one = np.unique(np.sort(pairs, axis=1), axis=0, return_index=True)
            u, v = ids[i][x[one]], ids[j][y[one]]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("cluster", "first", "second").applyInArrow(links, "u long, v long")


def _stars(buckets: DataFrame) -> DataFrame:
    """(a, b): each bucket's centre with each other member; the centre has most company."""
    company = buckets.groupBy("id").agg(F.sum("members").alias("company"))
    rows = buckets.join(company, "id")
    rank = F.struct("company", -F.col("id"))
    centres = rows.groupBy("bucket").agg(F.max_by("id", rank).alias("a"))
    pairs = buckets.select("bucket", F.col("id").alias("b")).join(centres, "bucket").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _judged(buckets: DataFrame, classes: DataFrame, judge: Judge, percent: int) -> DataFrame:
    """(a, b, star): the likely pairs inside each bucket, and whether one of a pair is the centre of a bucket, that is
    the member with most likely pairs."""
    parts = max(1, buckets.count() // JUDGED_ROWS)

    def pairs(table: pa.Table) -> pa.Table:
        bucket, ids = (table.column(c).to_numpy() for c in ("bucket", "id"))
        order = np.lexsort((ids, bucket))
        bucket, ids = bucket[order], ids[order]
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(ids) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(ids)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_))]
        for k in np.unique(sizes[sizes > 1]):
            first, second = np.triu_indices(k, 1)
            own, step = starts[sizes == k], max(1, JUDGED_PAIRS // len(first))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                a, b = (some[:, None] + first).ravel(), (some[:, None] + second).ravel()
                one = np.ones(len(a), dtype=np.int64)
                likely = judge(registers[a], registers[b], one, one, percent)
                a, b = a[likely], b[likely]
                degree = np.bincount(np.concatenate([a, b]), minlength=len(ids))
                centre = some + degree[some[:, None] + np.arange(k)].argmax(axis=1)
                centre = centre[np.searchsorted(some, a, side="right") - 1]
                found.append((ids[a], ids[b], (a == centre) | (b == centre)))
        a, b, star = (np.concatenate(x) for x in zip(*found))
        return pa.table({"a": a, "b": b, "star": star})

    rows = buckets.select("bucket", "id").join(classes.select("id", "registers"), "id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)))
    made = rows.groupBy("part").applyInArrow(pairs, "a long, b long, star boolean")
    return made.groupBy("a", "b").agg(F.max("star").alias("star"))


def _mixed_buckets(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, id, component) of the buckets whose members are in several components."""
    named = buckets.select("bucket", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    spread = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    # both members of a bucket of two have been compared
    return named.join(spread.filter("lo < hi and members > 2").select("bucket"), "bucket")


def _merged(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The labels, where those of a pair (rows of ``pairs``) have become one."""
    names, places = np.unique(pairs, return_inverse=True)
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in np.unique(places.reshape(-1, 2), axis=0).tolist():
        x, y = sorted((top(x), top(y)))
        root[y] = x
    at = np.minimum(np.searchsorted(names, labels), len(names) - 1)
    return np.where(names[at] == labels, names[[top(x) for x in range(len(names))]][at], labels)


def likely_groups(component: np.ndarray, n: np.ndarray, registers: np.ndarray, judge: Judge, percent: int) -> np.ndarray:
    """The group of each member of a bucket: components with a likely pair are in one. Pairs of one group are passed
    over, so near copies of one another, which soon are, take few of them."""
    order = np.argsort(n, kind="stable")
    n, registers = n[order], registers[order]
    labels = np.unique(component[order], return_inverse=True)[1]
    ends = np.searchsorted(percent * n, 100 * n, side="right")
    at, step = 0, 1
    while at < len(n):
        to = min(len(n), at + step)
        i, j = np.arange(at, to)[:, None], np.arange(at, ends[to - 1])
        a, b = np.nonzero((j > i) & (j < ends[i]) & (labels[i] != labels[j]))
        a, b = a + at, b + at
        for k in range(0, len(a), JUDGED_PAIRS):
            x, y = a[k : k + JUDGED_PAIRS], b[k : k + JUDGED_PAIRS]
            apart = labels[x] != labels[y]
            x, y = x[apart], y[apart]
            likely = judge(registers[x], registers[y], n[x], n[y], percent)
            if likely.any():
                labels = _merged(labels, np.stack([labels[x[likely]], labels[y[likely]]], axis=1))
        at, step = to, max(1, min(2 * step, MIXED_PLACES // len(n)))
    groups = np.empty_like(labels)
    groups[order] = labels
    return groups


def _likely_links(mixed: DataFrame, classes: DataFrame, judge: Judge, percent: int) -> DataFrame:
    """(u, v): links that put all likely pairs of ``mixed`` (bucket, id, component) in one cluster, if they share a
    bucket and are in different components. Classes (id, registers, and n if known)."""
    parts = max(1, mixed.count() // MIXED_ROWS)

    def links(table: pa.Table) -> pa.Table:
        bucket, ids, component, n = (table.column(c).to_numpy() for c in ("bucket", "id", "component", "n"))
        order = np.lexsort((ids, bucket))
        bucket, ids, component, n = bucket[order], ids[order], component[order], n[order]
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(ids) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(ids)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in np.unique(sizes[(sizes > 1) & (sizes <= MIXED_SMALL)]):
            first, second = np.triu_indices(k, 1)
            own, step = starts[sizes == k], max(1, JUDGED_PAIRS // len(first))
            for at in range(0, len(own), step):
                a, b = ((own[at : at + step, None] + x).ravel() for x in (first, second))
                able = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                a, b = a[able], b[able]
                likely = judge(registers[a], registers[b], n[a], n[b], percent)
                found.append((ids[a[likely]], ids[b[likely]]))
        for start, k in zip(starts[sizes > MIXED_SMALL], sizes[sizes > MIXED_SMALL]):
            own = slice(start, start + k)
            groups = likely_groups(component[own], n[own], registers[own], judge, percent)
            _, least, group = np.unique(groups, return_index=True, return_inverse=True)
            # a group of one component has nothing to compare
            several = np.bincount(group, weights=component[own] != component[own][least][group]) > 0
            found.append((ids[own][least][group][several[group]], ids[own][several[group]]))
        u, v = (np.concatenate(x) for x in zip(*found))
        return pa.table({"u": u, "v": v})

    rows = mixed.join(_with_sizes(classes).select("id", "n", "registers"), "id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts))).repartition(parts, "part")
    return rows.groupBy("part").applyInArrow(links, "u long, v long").distinct()


def _sized(sets: DataFrame, unpacked: Unpacker) -> DataFrame:
    """(id, n): how many codes each set has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, BLOCK_CLASSES):
                part = batch.slice(at, BLOCK_CLASSES)
                sizes = np.array([len(x) for x in unpacked(part.column("codes"))], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes)], names=["id", "n"])

    return sets.select("id", "codes").mapInArrow(rows, "id long, n long")


def _private(sets: DataFrame, unpacked: Unpacker, total: int) -> DataFrame:
    """(id, private): how many of the ``total`` codes of the sets stand in one only; each task counts its own sets
    first. Codes are dealt out by value as packed arrays, of some ``PART_CODES`` codes."""
    parts = max(1, -(-total // PART_CODES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at in range(0, batch.num_rows, BLOCK_CLASSES):
                some = batch.slice(at, BLOCK_CLASSES)
                found = unpacked(some.column("codes"))
                codes, first, times = np.unique(np.concatenate(found), return_index=True, return_counts=True)
                ids = np.repeat(some.column("id").to_numpy(), [len(x) for x in found])[first]
                ids = np.where(times == 1, ids, -1)
                part = codes % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                codes, ids, part = codes[order], ids[order], part[order]
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                ends = [*starts[1:], len(part)]
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for x in (codes, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), *packed], names=["part", "codes", "ids"])

    def once(table: pa.Table) -> pa.Table:
        codes, ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("codes", np.uint64), ("ids", np.int64)))
        _, first, times = np.unique(codes, return_index=True, return_counts=True)
        ids = ids[first[times == 1]]
        ids, private = np.unique(ids[ids >= 0], return_counts=True)
        return pa.table({"id": ids, "private": private.astype(np.int64)})

    counted = sets.select("id", "codes").mapInArrow(rows, "part long, codes binary, ids binary")
    return counted.groupBy("part").applyInArrow(once, "id long, private long").groupBy("id").agg(F.sum("private").alias("private"))


def near_components(
    classes: DataFrame, items: DataFrame, shingler: Shingler, judge: Judge, bands: int, per_band: int, percent: int
) -> DataFrame:
    """(node, component) of all classes with a link: component is the smallest id reachable over
    pairs with ``100 * common >= percent * union``.

    ``classes`` (id, n, registers), one row an id, has sets that are not empty; ``items`` (id, text)
    has a text of each class, and may have it several times and others besides.
    """
    banded = _banded(classes, bands, per_band)
    shared = durable(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared")
    buckets = durable(Members(shared, "bucket").among(banded, "bucket").join(shared, "bucket"), "buckets")
    return bucket_components(buckets, classes, lambda wanted: _sets(items, wanted, shingler), _stored, judge, percent)


def _named(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v) and the components they are in (cu, cv); one without links is its own."""
    for side in "uv":
        named = found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``found`` (node, component) with further links (u, v): only components with one are gone through."""
    if more.isEmpty():
        return found
    named = _named(more, found)
    merged = durable(components(named.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "merged")
    new = merged.withColumnRenamed("node", "known").withColumnRenamed("component", "least")
    old = found.join(new, found["component"] == new["known"], "left")
    old = old.select("node", F.coalesce("least", "component").alias("component"))
    return old.unionAll(merged.join(found, "node", "left_anti").select("node", "component"))


def bucket_components(
    buckets: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], unpacked: Unpacker, judge: Judge, percent: int,
    small: int = 0,
) -> DataFrame:
    """(node, component) of all classes (id, registers, and n if known) with a link to one in a bucket (bucket, id, members).

    ``sets_of`` gives the sets (id, codes, and n if known) of the classes (id) it is asked for, one row each; ``unpacked``
    makes sorted distinct codes of its column ``codes``, which may be anything shorter than the codes.
    Of buckets of up to ``small`` members all pairs are judged by signatures, whose sizes are not looked at, and sets
    are asked for once.
    """
    if not small:
        pairs = durable(_likely(_stars(buckets), classes, judge, percent), "pairs")
        members = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
        links = durable(_confirmed(pairs, durable(sets_of(members), "sets"), unpacked, percent), "links")
        found = durable(components(links), "components")
        mixed = durable(_mixed_buckets(buckets, found), "mixed")
        likely = durable(_likely_links(mixed, classes, judge, percent), "likely")
        return joined(found, _links_of_likely(likely, found, sets_of, unpacked, percent))

    judged = durable(_judged(buckets.filter(F.col("members") <= small), classes, judge, percent), "judged")
    buckets = buckets.filter(F.col("members") > small)
    any_large = not buckets.isEmpty()
    pairs, rest = judged.filter("star").select("a", "b"), judged.filter("not star")
    members = judged.select(F.explode(F.array("a", "b")).alias("id"))
    if any_large:
        large = durable(_likely(_stars(buckets), classes, judge, percent), "pairs")
        pairs = pairs.unionAll(large).distinct()
        members = members.unionAll(buckets.select("id"))
    sets = durable(sets_of(members), "sets")
    links = durable(_confirmed(pairs, sets, unpacked, percent), "links")
    found = durable(components(links), "components")
    rest = _named(rest.select(F.col("a").alias("u"), F.col("b").alias("v")), found).filter("cu <> cv")
    more = durable(_confirmed(rest.select(F.col("u").alias("a"), F.col("v").alias("b")), sets, unpacked, percent), "links")
    if any_large:
        more = more.unionAll(_links_of_mixed(buckets, found, lambda wanted: sets.join(wanted.select("id").distinct(), "id", "left_semi"), unpacked, percent))
    return joined(found, more)


def _links_of_mixed(
    buckets: DataFrame, found: DataFrame, sets_of: Callable[[DataFrame], DataFrame], unpacked: Unpacker, percent: int
) -> DataFrame:
    """Links (u, v) between different components of ``found`` inside buckets."""
    mixed = durable(_mixed_buckets(buckets, found), "mixed")
    sets = durable(sets_of(mixed), "sets")
    if "n" not in sets.columns:
        sets = sets.join(durable(_sized(sets, unpacked), "sizes"), "id")
    mixed = durable(mixed.join(_able(sets, unpacked, percent), "id", "left_semi"), "mixed")
    spread = mixed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("u"))
    joint = mixed.join(spread.filter("lo < hi"), "bucket")
    clusters = components(joint.select("u", F.col("id").alias("v")))
    rows = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("id"))
    rows = rows.join(mixed.select("id", "component").distinct(), "id").join(sets, "id")
    return durable(_block_links(_in_blocks(rows, _cluster_sizes(rows)), unpacked, percent), "links")


def _links_of_likely(
    likely: DataFrame, found: DataFrame, sets_of: Callable[[DataFrame], DataFrame], unpacked: Unpacker, percent: int
) -> DataFrame:
    """Links (u, v) between different components of ``found`` inside what ``likely`` (u, v) puts together."""
    if likely.isEmpty():
        return likely
    clusters = durable(components(likely), "clusters")
    sets = durable(sets_of(clusters.select(F.col("node").alias("id"))), "sets")
    if "n" not in sets.columns:
        sets = sets.join(durable(_sized(sets, unpacked), "sizes"), "id")
    rows = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("id"))
    rows = rows.join(_able(sets, unpacked, percent), "id", "left_semi").join(found.withColumnRenamed("node", "id"), "id", "left")
    rows = durable(rows.withColumn("component", F.coalesce("component", "id")), "clustered")
    sizes = durable(_cluster_sizes(rows.join(sets.select("id", "n"), "id")).filter("lo < hi"), "sizes")
    # the rows say little of the work, so their bytes must not decide on the tasks
    work = sizes.agg(F.sum(F.col("k") * F.col("k") / (2 * TASK_PAIRS) + F.col("total") * (F.col("blocks") + 1) / TASK_SHINGLES)).first()[0]
    rows = _in_blocks(rows.join(sets, "id"), sizes).repartition(int(work or 0) + 1, "cluster", "first", "second")
    return durable(_block_links(rows, unpacked, percent), "links")


def _able(sets: DataFrame, unpacked: Unpacker, percent: int) -> DataFrame:
    """(id) of the sets (id, n, codes) that have enough codes of others."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    private = sets.select("id", "n").join(_private(sets, unpacked, total), "id", "left")
    return private.filter(100 * (F.col("n") - F.coalesce("private", F.lit(0))) >= percent * F.col("n")).select("id")


def _cluster_sizes(rows: DataFrame) -> DataFrame:
    """(cluster, k, total, lo, hi, blocks) of rows (cluster, component, n): classes and shingles, the range of
    components, and how many blocks they make."""
    sizes = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    return sizes.withColumn("blocks", blocks)


def _in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows (cluster, id, component, codes) of clusters with sizes, for each pair of blocks (first, second)."""
    rows = rows.join(sizes.select("cluster", "blocks"), "cluster")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return rows.select("cluster", "first", "second", "block", "id", "component", "codes")
