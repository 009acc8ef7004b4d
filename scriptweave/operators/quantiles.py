"""Exact quantiles of any number of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1024


def _order_statistic(values: DataFrame, value: str, weight: str, low: int, high: int, rank: int) -> int:
    """The value at a rank (from 0), by rounds of bucket counts: each round leaves one bucket."""
    before = 0
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.floor((F.col(value) - low) / width) if width > 1 else F.col(value) - low
        inside = values.filter(F.col(value).between(low, high))
        counts = inside.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum(weight).alias("n"))
        for number, n in sorted(map(tuple, counts.collect())):  # at most BUCKETS rows
            if before + n > rank:
                break
            before += n
        low, high = low + number * width, min(high, low + (number + 1) * width - 1)
    return low


def exact_quantile(values: DataFrame, value: str, quantile: float, weight: str | None = None) -> float | None:
    """The quantile of a column of whole numbers, each counted ``weight`` times, interpolated between the two
    order statistics around it; None without values.

    The range is cut into buckets that are counted, the bucket that holds the rank is cut again, and so on: a few
    passes of small sums, whatever the number of distinct values. Nulls are left out.
    """
    rows = values.filter(F.col(value).isNotNull())
    rows = rows.select(F.col(value).cast("long").alias("v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    low, high, total = rows.agg(F.min("v"), F.max("v"), F.sum("w")).first()
    if not total:
        return None
    place = quantile * (total - 1)
    first = _order_statistic(rows, "v", "w", low, high, math.floor(place))
    if place == math.floor(place):
        return float(first)
    second = _order_statistic(rows, "v", "w", first, high, math.ceil(place) - _below(rows, first))
    return first + (second - first) * (place - math.floor(place))


def _below(rows: DataFrame, value: int) -> int:
    return rows.filter(F.col("v") < value).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
