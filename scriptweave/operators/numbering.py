"""Running totals over groups of any size.

A window with a few huge groups (lines per speaker) would sort each group in one task. Here the
rows are put in order by a range partitioning, whose ranges are of about one size however the
rows are numbered. Each range adds up its part of each group; the sums, one row per group and
range, give every range its starting values; and the windows end at the range's edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .durable import durable

_PART, _ROW = "_part", "_is_row"


def _range_partitioned(df: DataFrame, order: list[Column], ranges: int | None) -> DataFrame:
    """Rows in ranges of ``order``, the range of a row kept with it on storage: computed
    twice, a range partitioning could cut elsewhere."""
    ordered = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return durable(ordered.withColumn(_PART, F.spark_partition_id()), "ranges")


def preceding_totals(
    df: DataFrame, order: list[Column], totals: dict[str, tuple[list[str], str]], ranges: int | None = None
) -> DataFrame:
    """Adds to each row the sum over all rows before it in its group.

    ``order`` orders all rows without ties; ``totals`` maps a new column to its group columns
    (none: all rows are one group) and the column to add up. Keep the rows narrow: they are
    written once and move twice. A range's starting values travel as rows of their own at its
    head, so nothing is joined, and NULL is a group like any other. Where all rows are one group,
    one window holds one row per range.
    """
    rows = placed = _range_partitioned(df, order, ranges)
    values = {name: f"_value{i}" for i, name in enumerate(totals)}
    rows = rows.withColumns({values[n]: F.coalesce(F.col(v), F.lit(0)) for n, (_, v) in totals.items()})
    rows = rows.withColumn(_ROW, F.lit(True))
    for name, (group, value) in totals.items():
        sums = placed.groupBy(*group, _PART).agg(F.sum(value).alias("_sum"))
        before = W.partitionBy(*group).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
        start = F.sum("_sum").over(before).alias(values[name])
        starts = sums.select(*group, _PART, start, F.lit(False).alias(_ROW)).filter(f"{values[name]} <> 0")
        rows = rows.unionByName(starts, allowMissingColumns=True)
    rows = rows.repartition(_PART)  # serves all windows below
    sums = {}
    for name, (group, _) in totals.items():
        inside = W.partitionBy(_PART, *group).orderBy(_ROW, *order).rowsBetween(W.unboundedPreceding, -1)
        sums[name] = F.coalesce(F.sum(values[name]).over(inside), F.lit(0))
    return rows.withColumns(sums).filter(_ROW).drop(_PART, _ROW, *values.values())


def running_totals(
    df: DataFrame, order: list[str], totals: dict[str, tuple[list[str], Column]], ranges: int | None = None
) -> DataFrame:
    """Adds running totals, each row's own value included.

    Rows are ordered by the columns ``order``, without ties; ``totals`` maps a new column to its
    group columns and the value to add up.
    """
    steps = {n: f"_step{i}" for i, n in enumerate(totals)}
    rows = df.withColumns({steps[n]: v for n, (_, v) in totals.items()})
    wanted = {n: (group, steps[n]) for n, (group, _) in totals.items()}
    rows = preceding_totals(rows, [F.col(c) for c in order], wanted, ranges)
    rows = rows.withColumns({n: (F.col(n) + F.coalesce(F.col(s), F.lit(0))).cast("long") for n, s in steps.items()})
    return rows.drop(*steps.values())


def _as_in(df: DataFrame, field: str, name: str) -> Column:
    """A column read back, without nulls where the field it came from has none: else keys that are the same
    would be of two types, and rows that lie right would be moved again."""
    kind = df.select(field).schema[0]
    zero = F.lit("") if kind.dataType.simpleString() == "string" else F.lit(0)
    return F.col(name) if kind.nullable else F.coalesce(F.col(name), zero.cast(kind.dataType))


def with_running_totals(
    lines: DataFrame, order: list[str], totals: dict[str, tuple[list[str], Column]], ranges: int | None = None
) -> DataFrame:
    """The same for rows with texts: only keys and values are put in order, and every row finds its
    totals by a key of its own. The texts move once.

    Rows that share the ``order`` columns are ordered by a hash of all their columns. Rows that are equal
    altogether share a key and are numbered within it, so none is multiplied and each has its own total.
    """
    groups = [c for group, _ in totals.values() for c in group]
    keys = list(dict.fromkeys([*order, *groups]))
    values = {n: f"_from{i}" for i, n in enumerate(totals)}
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], F.xxhash64(*lines.columns).alias("digest"))
    lines = lines.withColumn("_key", key)
    narrow = lines.groupBy("_key", *keys, *[v.alias(values[n]) for n, (_, v) in totals.items()]).agg(F.count(F.lit(1)).alias("_copies"))
    places = {f"_order{i}": F.col(f"_key.k{i}") for i in range(len(order))} | {"_order_digest": F.col("_key.digest")}
    narrow = narrow.withColumns(places | {f"{v}_all": F.col(v) * F.col("_copies") for v in values.values()})
    wanted = {n: (group, f"{values[n]}_all") for n, (group, _) in totals.items()}
    found = preceding_totals(narrow.drop("_key"), [F.col(c) for c in places], wanted, ranges)
    again = F.struct(*[_as_in(lines, f"_key.k{i}", f"_order{i}").alias(f"k{i}") for i in range(len(order))], _as_in(lines, "_key.digest", "_order_digest").alias("digest"))
    found = found.select(again.alias("_key"), *totals, *values.values())
    # the window's rows lie and are sorted as the join wants them
    nth = F.row_number().over(W.partitionBy("_key").orderBy("_key"))
    rows = lines.drop(*totals).withColumn("_nth", nth).join(found, "_key")
    added = {n: (F.col(n) + F.coalesce(F.col(v), F.lit(0)) * F.col("_nth")).cast("long") for n, v in values.items()}
    return rows.withColumns(added).drop("_key", "_nth", *values.values())


def bucketed_totals(lines: DataFrame, totals: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """Running totals by (id, line_no) of a table bucketed by (id, part), parts being ranges of line numbers.

    No line is moved: a block, one part of an id, lies in one bucket, where its lines are numbered and added up. Only
    the blocks' sums, one row per block and group, are put in order, and each block is joined with what its groups begin
    with, a list no longer than the block. Rows that share a line number are ordered by a hash of all their columns;
    rows without an id or a line number are counted nowhere and get nulls.
    """
    block = ["id", "part"]
    counted = F.col("id").isNotNull() & F.col("line_no").isNotNull()
    rows, starts = lines.withColumn("_tie", F.xxhash64(*lines.columns)), None
    for i, (group, value) in enumerate(totals.values()):
        rows = rows.withColumn(f"_value{i}", F.when(counted, F.coalesce(value, F.lit(0))).otherwise(0))
        others = [c for c in group if c not in block]
        sums = rows.filter(counted).groupBy(*block, *others).agg(F.sum(f"_value{i}").alias("_sum"))
        before = preceding_totals(sums, [F.col(c) for c in [*block, *others]], {"_start": (group, "_sum")})
        entry = F.struct(F.struct(F.lit(0).alias("of"), *others).alias("key"), F.col("_start").alias("value"))
        found = before.groupBy(*block).agg(F.map_from_entries(F.collect_list(entry)).alias(f"_starts{i}"))
        starts = found if starts is None else starts.join(found, block)
        inside = W.partitionBy(*block, *others).orderBy("line_no", "_tie").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn(f"_within{i}", F.sum(f"_value{i}").over(inside))
    rows = rows.join(starts, block, "left")
    for i, (name, (group, _)) in enumerate(totals.items()):
        key = F.struct(F.lit(0).alias("of"), *[c for c in group if c not in block])
        rows = rows.withColumn(name, (F.col(f"_starts{i}")[key] + F.col(f"_within{i}")).cast("long"))
    return rows.drop("_tie", *[f"_{kind}{i}" for i in range(len(totals)) for kind in ("value", "starts", "within")])


def ordinals(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the place of a column's value among its distinct values in order, from 1; NULL first."""
    distinct = df.select(F.col(column).alias("_item"), F.lit(1).alias("_one")).distinct()
    placed = preceding_totals(distinct, [F.col("_item")], {name: ([], "_one")})
    placed = placed.select("_item", (F.col(name) + 1).cast("long").alias(name))
    return df.join(placed, F.col(column).eqNullSafe(F.col("_item")), "left").drop("_item")
