"""K-d tree sharding in DataFrame operations.

Documents are points: size on a logarithmic scale, source and language, each a number of 28 bits. The
tree starts with one node for all shards. Each level splits every node that stands for several
shards, along the dimension in which it is widest, at the weighted median (or the matching quantile
where the shards do not halve evenly) of the documents' bytes, until each node is one shard of the
target size. A quantile is found like a number is guessed: bytes by node and bucket of a dimension,
then the boundary bucket finer, and ties on the dimension by a hash of the id, so that a source with
a third of all rows, or a thousand equal points, splits like any other.

Only (key, size, dimensions) is kept, on shared storage; a level writes it once with
its new nodes. A
search adds up at most 16,384 buckets a node, each task its own rows first, and from its second
round on reads only the rows of boundary buckets. The nodes are a table, too, with a row for each, which
the points are joined with; the driver holds but the number of shards.

Null or empty texts have only the fixed 8 bytes. A null in a dimension is its lowest value. Repeated
rows are points of their own, in any order among themselves. An empty table gives no rows. Further
columns are carried along; a result replaces a column of its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.durable import durable

BITS, BUCKET_BITS = 28, 14
OVERHEAD_BYTES = 8
ROWS_PER_BLOCK = 1_000_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text and a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD_BYTES


def hashed(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(c), 64 - BITS))


def log_scaled(c: Column) -> Column:
    """Numbers up to 2^40 on a logarithmic scale of 28 bits."""
    unit = float(1 << BITS) / 40
    return F.coalesce(F.least((F.log2(F.greatest(c, F.lit(0)) + 1.0) * unit).cast("long"), F.lit((1 << BITS) - 1)), F.lit(0))


def _widest(placed: DataFrame, nodes: DataFrame, dims: list[str]) -> DataFrame:
    """For each node (_node, _shards) with points the dimension in which it is widest, the first of equal ones, and
    the bytes that go left."""
    bounds = [f(d).alias(f"_{f.__name__}{d}") for d in dims for f in (F.min, F.max)]
    ranges = placed.join(nodes, "_node").groupBy("_node", "_shards").agg(F.sum("_size").alias("_held"), *bounds)
    widths = F.array(*[F.col(f"_max{d}") - F.col(f"_min{d}") for d in dims])
    left = F.floor(F.col("_shards") / 2).cast("int")
    return ranges.select(
        "_node", "_shards", left.alias("_left"), (F.array_position(widths, F.array_max(widths)) - 1).cast("int").alias("_dim"),
        (F.col("_held") * left / F.col("_shards")).alias("_wanted"),
    )


def _cuts(placed: DataFrame, nodes: DataFrame, dims: list[str]) -> DataFrame:
    """Adds to each node of ``_widest`` the (_edge, _tie_edge) up to which points go left."""
    number = F.get(F.array(*dims), F.col("_dim"))
    rows = placed.join(nodes.select("_node", "_dim"), "_node").select("_node", "_size", "_tie", number.alias("_number"))
    for value, cut in (("_number", "_edge"), ("_tie", "_tie_edge")):
        for shift in range(BITS - BUCKET_BITS, -1, -BUCKET_BITS):
            sums = rows.groupBy("_node", F.shiftright(value, shift).alias("_bucket")).agg(F.sum("_size").alias("_held"))
            upto = W.partitionBy("_node").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
            over = sums.withColumn("_upto", F.sum("_held").over(upto)).join(nodes.select("_node", "_wanted"), "_node")
            over = over.filter(F.col("_upto") > F.col("_wanted"))
            found = over.groupBy("_node").agg(F.min_by(F.struct("_bucket", "_held", "_upto"), "_bucket").alias("_at"))
            wanted = F.col("_wanted") - (F.col("_at._upto") - F.col("_at._held"))
            # the last bucket is on the side that comes nearer to the quantile
            nearer = (wanted < F.col("_at._held") / 2).cast("long") if value == "_tie" and not shift else F.lit(0)
            nodes = nodes.join(found, "_node").withColumns({cut: F.col("_at._bucket") - nearer, "_wanted": wanted})
            nodes = durable(nodes.drop("_at"), "nodes")
            if value == "_tie" and not shift:
                return nodes
            rows = rows.join(nodes.select("_node", cut), "_node").filter(F.shiftright(value, shift) == F.col(cut)).drop(cut)
            if value == "_number" and shift:
                rows = durable(rows, "boundary")


def kd_shards(
    documents: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    dimensions: dict[str, Column] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds size, shard (from 0) and slot (gapless from 0 in its shard, by key).

    ``shards``, or as many as ``target_bytes`` asks for. ``dimensions`` names 28-bit numbers;
    ``keep`` the columns to carry (default: all).
    """
    keep = {c: F.col(f"`{c}`") for c in documents.columns} if keep is None else keep
    keep = {c: value for c, value in keep.items() if c.lower() not in ("size", "shard", "slot")}
    if dimensions is None:
        dimensions = {
            "size": log_scaled(F.octet_length(text)),
            "source": hashed(F.col("source")),
            "lang": hashed(F.col("lang")),
        }
    dims = [f"_d{i}" for i in range(len(dimensions))]
    points = documents.select(
        *[c.alias(f"_k{i}") for i, c in enumerate(keep.values())],
        F.col(f"`{key}`").alias("_key"),
        text_bytes(F.col(f"`{text}`")).alias("_size"),
        hashed(F.struct(F.col(f"`{key}`"), F.crc32(F.col(f"`{text}`").cast("binary")))).alias("_tie"),
        *[c.alias(d) for c, d in zip(dimensions.values(), dims)],
    )
    points = durable(points, "points")
    if shards is None:
        total = points.agg(F.sum("_size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    count = points.count()
    placed = points.withColumn("_node", F.lit(0))
    nodes = documents.sparkSession.range(1).select(F.lit(0).alias("_node"), F.lit(shards).alias("_shards"))
    most = shards if count else 1
    while most > 1:
        cuts = _cuts(placed, durable(_widest(placed, nodes, dims), "nodes"), dims)
        number = F.get(F.array(*dims), F.col("_dim"))
        beyond = (number > F.col("_edge")) | ((number == F.col("_edge")) & (F.col("_tie") > F.col("_tie_edge")))
        moved = F.when(beyond, F.col("_node") + F.col("_left")).otherwise(F.col("_node"))
        kept = [c for c in placed.columns if c != "_node"]
        placed = durable(placed.join(cuts, "_node", "left").select(*kept, moved.alias("_node")), "placed")
        halves = cuts.select("_node", F.col("_left").alias("_shards"))
        others = cuts.select((F.col("_node") + F.col("_left")).alias("_node"), (F.col("_shards") - F.col("_left")).alias("_shards"))
        nodes = halves.unionByName(others).filter("_shards > 1")
        most -= most // 2
    placed = _numbered(placed, max(1, math.ceil(count / rows_per_block)))
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return placed.select(*kept, F.col("_size").alias("size"), F.col("_node").alias("shard"), "slot")


def _numbered(points: DataFrame, blocks: int) -> DataFrame:
    """Numbers the rows of each shard: blocks of hashes in parallel, and an offset for each block."""
    cut = points.withColumn("_block", F.pmod(F.col("_tie"), F.lit(blocks)))
    counts = cut.groupBy("_node", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_node").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_node").alias("_node2"), F.col("_block").alias("_block2"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = W.partitionBy("_node", "_block").orderBy("_key", "_tie")
    numbered = cut.withColumn("_row", F.row_number().over(inside) - 1)
    same = (F.col("_node") == F.col("_node2")) & (F.col("_block") == F.col("_block2"))
    return numbered.join(starts, same).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long"))
