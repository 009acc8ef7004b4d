"""Smoothed trends of a series per group: of fixed bandwidth, and of a span of nearest points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .durable import durable
from .numbering import preceding_totals, running_totals


def trend_smooth(series: DataFrame, group: list[str], x: str, y: str, bandwidth: int) -> DataFrame:
    """Local linear fit with tricube weights at each x of each group.

    ``group`` names any columns; ``x`` is an integer, such as an ordinal of ids; points nearer than ``bandwidth`` count. Each point is first added
    up with others at its x, then sends its share to the x values within reach: a fixed
    number of rows per point and one shuffle on (group, x), whatever the group's size.
    Where the fit has no slope, the weighted mean stands in.
    """
    points = series.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = points.groupBy(*group, x).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(y).cast("double")).alias("_y")
    )
    shifts = F.sequence(F.lit(1 - bandwidth), F.lit(bandwidth - 1))
    # d: position of the point as seen from the x it is sent to
    sent = points.select(*group, x, "_n", "_y", F.explode(shifts).alias("_d"))
    closeness = F.abs(F.col("_d")).cast("double") / F.lit(float(bandwidth))
    weight = F.pow(1 - F.pow(closeness, F.lit(3)), F.lit(3))
    sent = sent.withColumn("_w", weight)

    def moment(e: Column, name: str) -> Column:
        return F.sum(e).alias(name)

    w, d, n, sy = F.col("_w"), F.col("_d"), F.col("_n"), F.col("_y")
    fitted = sent.groupBy(*group, (F.col(x) - d).alias(x)).agg(
        moment(w * n, "s0"),
        moment(w * d * n, "s1"),
        moment(w * d * d * n, "s2"),
        moment(w * sy, "t0"),
        moment(w * d * sy, "t1"),
        F.max(d == 0).alias("_here"),
    )
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    spread = s0 * s2 - s1 * s1
    fit = F.when(spread > 1e-9, (s2 * t0 - s1 * t1) / spread).otherwise(t0 / s0)
    return fitted.filter("_here").select(*group, x, fit.alias("trend"))


def trend_span(
    series: DataFrame, group: list[str], x: str, y: str, span: float = 0.75, cell: float = 0.2
) -> DataFrame:
    """Local linear fit over the nearest ``span`` of a group's points, however sparse x is.

    As the plot library's smoother does it: fits are made at a few vertices, cut so that a cell holds about
    ``span * cell`` of the points, and a cubic with the fits' values and slopes runs between them. A point counts
    by a tricube of its distance in units of the distance of the farthest of the span; that distance is found
    by rank, from running totals over the points in order of distance. Every point goes to each of its group's
    vertices, a number that the span bounds, and sums meet per vertex: no group lies in one task.

    ``x`` is a number; rows without x or y are left out. Where the fit has no slope, the weighted mean stands in.
    """
    cells = math.ceil(1 / (span * cell))
    at = F.col(x).cast("double")
    points = series.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = points.groupBy(*group, x).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_y"))
    order = [F.col(c) for c in [*group, x]]
    points = durable(preceding_totals(points, order, {"_before": (group, "_n")}), "points")
    totals = points.groupBy(*group).agg(F.sum("_n").alias("_all"), F.min(at).alias("_first"), F.max(at).alias("_last"))

    def same(other: DataFrame) -> Column:
        return _same_names(points, other, group)

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[c for c in df.columns if c not in group])

    totals = keyed(totals)
    ranked = points.join(totals, same(totals)).drop(*[c for c in totals.columns if c.startswith("_g_")])
    # a vertex wherever another cell's share of the points begins, and at both ends
    place = F.floor(F.col("_before") * cells / F.col("_all"))
    behind = F.floor((F.col("_before") + F.col("_n")) * cells / F.col("_all"))
    edge = (at == F.col("_first")) | (at == F.col("_last")) | (behind > place)
    reach = F.greatest(F.lit(2), F.floor(F.lit(span) * F.col("_all") + 1e-9)).cast("long")
    vertices = keyed(durable(ranked.filter(edge).select(*group, at.alias("_v"), F.least(reach, "_all").alias("_q")), "vertices"))
    seen = points.join(vertices, same(vertices)).select(*group, x, "_n", "_y", "_v", "_q")
    seen = seen.withColumn("_d", at - F.col("_v")).withColumn("_far", F.abs("_d"))
    upto = running_totals(seen.select(*group, "_v", "_q", "_far", x, "_n"), [*group, "_v", "_far", x], {"_upto": ([*group, "_v"], F.col("_n"))})
    widths = keyed(upto.filter("_upto >= _q").groupBy(*group, "_v").agg(F.min("_far").alias("_h")))
    widths = widths.withColumnRenamed("_v", "_hv")
    near = seen.join(widths, _same_names(seen, widths, group) & (seen["_v"] == widths["_hv"]))
    near = near.select(*group, "_v", "_d", "_n", "_y", "_far", "_h").filter("_far < _h or _far = 0")
    u = F.when(F.col("_far") == 0, F.lit(0.0)).otherwise(F.col("_far") / F.col("_h"))
    w, d = F.pow(1 - F.pow(u, F.lit(3)), F.lit(3)), F.col("_d")
    near = near.withColumn("_w", w)
    w, n, sy = F.col("_w"), F.col("_n"), F.col("_y")
    moments = {"s0": w * n, "s1": w * d * n, "s2": w * d * d * n, "t0": w * sy, "t1": w * d * sy}
    fits = near.groupBy(*group, "_v").agg(*[F.sum(e).alias(name) for name, e in moments.items()])
    s0, s1, s2, t0, t1 = (F.col(c) for c in moments)
    spread = s0 * s2 - s1 * s1
    sloped = spread > 1e-9
    fits = fits.select(
        *group, "_v", F.when(sloped, (s2 * t0 - s1 * t1) / spread).otherwise(t0 / s0).alias("_a"),
        F.when(sloped, (s0 * t1 - s1 * t0) / spread).otherwise(F.lit(0.0)).alias("_b"),
    )
    onward = W.partitionBy(*group).orderBy("_v")  # a group has a few vertices
    fits = fits.select("*", *[F.lead(c).over(onward).alias(f"{c}2") for c in ("_v", "_a", "_b")])
    fits = keyed(fits)
    rows = points.join(fits, same(fits) & (at >= F.col("_v")) & ((at < F.col("_v2")) | (F.col("_v2").isNull() & (at == F.col("_v")))))
    width = F.col("_v2") - F.col("_v")
    t = (at - F.col("_v")) / width
    blend = (
        (2 * t * t * t - 3 * t * t + 1) * F.col("_a") + (t * t * t - 2 * t * t + t) * width * F.col("_b")
        + (3 * t * t - 2 * t * t * t) * F.col("_a2") + (t * t * t - t * t) * width * F.col("_b2")
    )
    return rows.select(*[points[c] for c in group], x, F.when(F.col("_v2").isNull(), F.col("_a")).otherwise(blend).alias("trend"))


def _same_names(left: DataFrame, right: DataFrame, group: list[str]) -> Column:
    found = F.lit(True)
    for c in group:
        found = found & left[c].eqNullSafe(right[f"_g_{c}"])
    return found
