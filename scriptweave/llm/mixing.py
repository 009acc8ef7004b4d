"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place between 0 and 2^40 in its source, a hash of its id and text. Sizes are
added up by source and the place's first ten bits; running sums find the bucket in which a source's
budget ends; only that bucket is then split by the next ten bits, and so on down to single places.
A document is in the budget when its place lies below the threshold: one filter, no sorting. A budget
of 2.3 times a source is two whole copies and a budget of 0.3; thresholds are nested, so a larger
budget only adds documents.

Null texts have size 0. Documents without words fall under the same rule and take nothing. Repeated
rows share a place and are taken together. A null source is one source. Other columns are carried along; a
result replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.durable import durable
from ..operators.numbering import preceding_totals

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BITS = 10
ROUNDS = 4
PLACE_BITS = BITS * ROUNDS
_RESULTS = {"size", "source_size", "target", "copies", "taken"}
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def place(*columns: Column) -> Column:
    """An evenly spread number of 40 bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - PLACE_BITS)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources (source, source_size): shares of the total by weight, none above ``most``
    times its source; what is over goes to the others by weight until none is above.

    Weights repeat over the sources in code point order, null last. Ranks come from a range
    partitioning and each round of sharing is one small aggregate, so there may be many sources.
    """
    order = [F.col("source").isNull(), F.col("source").asc_nulls_last()]
    ranked = preceding_totals(sources.withColumn("_one", F.lit(1)), order, {"_rank": ([], "_one")})
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = durable(ranked.select("source", "source_size", cases.alias("weight")), "sources")
    limit = F.col("source_size") * float(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # A source is at its limit once its share reaches it; shares only grow, so this ends.
    per_weight, before = 0.0, -1
    while True:
        at_limit = limit <= per_weight * F.col("weight")
        full, rest, count = weighed.agg(
            F.sum(F.when(at_limit, limit)), F.sum(F.when(~at_limit, F.col("weight"))), F.count_if(at_limit)
        ).first()
        if count == before or not rest:
            break
        before, per_weight = count, (total - (full or 0.0)) / rest
    target = F.least(limit, F.col("weight") * per_weight) if rest else limit
    return weighed.withColumn("target", target)


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source with a budget the place below which its documents are taken.

    ``sizes`` has (source, place, size), ``budgets`` (source, budget). A round adds up at most 1,024
    buckets a source, each task its own rows first; from the second on only the rows of the boundary
    buckets are read. The last boundary bucket, whose documents share 40 bits of hash, is taken where
    that comes nearer to the budget.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("from_place"))
    for k in range(ROUNDS):
        shift = PLACE_BITS - BITS * (k + 1)
        bucket = F.shiftleft(F.shiftright("place", shift), shift)
        sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
        same = sums["source"].eqNullSafe(state["source"])
        sums = sums.join(state, same).drop(state["source"])
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        over = sums.withColumn("upto", F.sum("held").over(upto)).filter(F.col("upto") > F.col("left"))
        found = over.groupBy("source").agg(F.min_by(F.struct("bucket", "held", "upto", "left"), "bucket").alias("at"))
        last = k == ROUNDS - 1
        left = F.col("at.left") - (F.col("at.upto") - F.col("at.held"))
        nearer = F.lit(last) & (F.col("at.held") - left < left)
        state = durable(
            found.select(
                "source", left.alias("left"), F.when(nearer, F.col("at.bucket") + 1).otherwise(F.col("at.bucket")).alias("from_place")
            ),
            "thresholds",
        )
        if not last:
            inside = sizes["source"].eqNullSafe(state["source"]) & (bucket == state["from_place"])
            sizes = durable(sizes.join(state, inside, "left_semi"), "boundary")
    return state.select("source", F.col("from_place").alias("below"))


def mixed(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds to each document size, source_size, target (its source's), copies and taken.

    ``keep`` names the columns to carry (default: all). The texts are read once for their sizes and
    once more only if they are carried. All joins are with one row per source.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in _RESULTS]
    measured = [
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        place(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("place"),
    ]
    sizes = durable(documents.select(*measured), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = durable(
        source_targets(totals, weights, most)
        .withColumn("whole", F.least(F.floor(ratio + 1e-9), F.lit(most)).cast("long"))
        .withColumn("budget", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))),
        "targets",
    )
    below = thresholds(sizes, targets.filter("budget > 0").select("source", "budget"))
    same = targets["source"].eqNullSafe(below["source"])
    plan = targets.join(below, same, "left").select(
        targets["source"].alias("_source"), "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")
    )
    carried = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    rows = documents.select(*carried, *measured)
    more = ((F.col("place") < F.col("below")) & (F.col("whole") < most)).cast("long")
    rows = rows.join(durable(plan, "plan"), F.col("source").eqNullSafe(F.col("_source")))
    return rows.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)],
        "size", "source_size", "target",
        (F.col("whole") + more).alias("copies"),
        ((F.col("whole") + more) * F.col("size")).alias("taken"),
    )


def repeated(
    documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mixed documents themselves, all their columns: each row as often as the mix takes it."""
    names = {c: f"in_{i}" for i, c in enumerate(documents.columns)}
    rows = mixed(documents.toDF(*names.values()), names[key], names[text], names[source], **options)
    rows = rows.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*names.values()).toDF(*documents.columns)
