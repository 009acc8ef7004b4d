"""Running totals in ranges against plain windows."""

import pytest
from pyspark.sql import Window as W, functions as F

from scriptweave.operators import words as Words
from scriptweave.operators.lines import scene_number
from scriptweave.operators.numbering import (
    _range_partitioned, ordinals, preceding_totals, running_totals, with_running_totals,
)
from scriptweave.sources.lines import write_bucketed


@pytest.fixture(scope="module")
def lines(spark):
    """One speaker with a third of all lines, one id with a third of all, ids out of line with seasons."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.pmod(F.xxhash64("id"), F.lit(40)))).alias("id"),
        F.col("id").alias("line_no"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0, "mia")
        .otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)))).alias("person"),
        F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0, "scene").alias("type"),
    )
    return df.withColumn("season", F.pmod(F.xxhash64("id"), F.lit(4)).cast("string"))


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_line_numbers(lines, ranges):
    numbered = Words.number_lines(lines, ranges=ranges)
    for name, group in Words.NUMBERS.items():
        w = W.partitionBy(*group).orderBy("id", "line_no")
        numbered = numbered.withColumn(f"w_{name}", F.row_number().over(w))
    assert numbered.count() == 3000
    assert numbered.filter(" or ".join(f"{n} <> w_{n}" for n in Words.NUMBERS)).count() == 0


@pytest.mark.parametrize("ranges", [3, 40])
def test_scene_number(lines, ranges):
    w = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    both = scene_number(lines, ranges=ranges).withColumn("plain", F.count(F.when(F.col("type") == "scene", 1)).over(w))
    assert both.filter("scene <> plain").count() == 0
    # never decreasing, by at most one a line
    steps = both.withColumn("step", F.col("scene") - F.lag("scene").over(W.partitionBy("id").orderBy("line_no")))
    assert {r.step for r in steps.select("step").distinct().collect()} <= {None, 0, 1}


def test_line_numbers_far_apart(lines, spark):
    """Numbers a million apart: ranges hold rows, not stretches of numbers."""
    sparse = lines.withColumn("line_no", F.col("line_no") * 1_000_000)
    numbered = running_totals(sparse, ["id", "line_no"], {"n": (["person"], F.lit(1))}, ranges=20)
    w = W.partitionBy("person").orderBy("id", "line_no")
    assert numbered.withColumn("plain", F.row_number().over(w)).filter("n <> plain").count() == 0
    assert numbered.count() == 3000
    parts = _range_partitioned(sparse, [F.col("id"), F.col("line_no")], 20).groupBy("_part").count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 3000 / 5


def test_order_by_two_columns(spark):
    rows = [("a", 2, 1, "scene"), ("a", 1, 9, None), ("a", 2, 0, None), ("a", 3, 2, "scene")]
    df = spark.createDataFrame(rows, "id string, ts long, line_no long, type string")
    got = scene_number(df, ["ts", "line_no"])
    assert {(r.ts, r.line_no, r.scene) for r in got.collect()} == {(1, 9, 0), (2, 0, 0), (2, 1, 1), (3, 2, 2)}


def test_null_keys_are_a_group(spark):
    rows = [(None, 1, "a"), (None, 2, None), ("x", 1, None), ("x", 2, "a"), (None, 3, None)]
    df = spark.createDataFrame(rows, "id string, line_no long, person string")
    expected = {(None, 1, 1), (None, 2, 1), (None, 3, 2), ("x", 1, 3), ("x", 2, 2)}
    for ranges in (1, 4):
        for numbered in (running_totals, with_running_totals):
            got = numbered(df, ["id", "line_no"], {"n": (["person"], F.lit(1))}, ranges)
            assert {(r.id, r.line_no, r.n) for r in got.collect()} == expected


def test_values_of_null_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3)], "id string, line_no long, step int")
    got = running_totals(df, ["id", "line_no"], {"n": (["id"], F.col("step"))})
    assert sorted((r.line_no, r.n) for r in got.collect()) == [(1, 0), (2, 3)]
    assert running_totals(df.limit(0), ["id", "line_no"], {"n": (["id"], F.col("step"))}).count() == 0


def test_ordinals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "id string")
    assert sorted((str(r.id), r.n) for r in ordinals(df, "id", "n").collect()) == [("None", 1), ("a", 2), ("b", 3), ("b", 3), ("c", 4)]


def test_preceding_totals_of_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit(1).alias("one"))
    got = preceding_totals(df, [F.desc("k")], {"before": ([], "one")})
    assert got.filter("before <> 499 - k").count() == 0


@pytest.mark.parametrize("part_lines", [64, 5000])
def test_bucketed_numbers(spark, lines, part_lines):
    """Long ids in many parts and in one, people and seasons that are null, rows without an id or a number."""
    person = F.when(F.col("line_no") % 50 != 0, F.col("person"))
    season = F.when(F.col("line_no") % 70 != 0, F.col("season"))
    odd = spark.createDataFrame([(None, 5, "mia"), ("hot", None, "mia")], "id string, line_no long, person string")
    rows = lines.withColumns({"person": person, "season": season}).unionByName(odd, allowMissingColumns=True)
    table = write_bucketed(rows, 8, part_lines=part_lines)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Words.numbers_in_buckets(spark.table(table))
        plan = got._jdf.queryExecution().executedPlan().toString()
        # the join's left side is the table, which moves nowhere
        assert "Exchange" not in plan[: plan.index("FileScan")] and "Bucketed: true" in plan
        got = got.cache()
        assert got.count() == 3002
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")
    numbers = ["scene", *Words.NUMBERS]
    none = got.filter("id is null or line_no is null")
    assert none.count() == 2 and none.filter(" and ".join(f"{n} is null" for n in numbers)).count() == 2
    plain = got.filter("id is not null and line_no is not null")
    for name, group in Words.NUMBERS.items():
        plain = plain.withColumn(f"w_{name}", F.row_number().over(W.partitionBy(*group).orderBy("id", "line_no")))
    scenes = F.count(F.when(F.col("type") == "scene", 1)).over(W.partitionBy("id").orderBy("line_no"))
    plain = plain.withColumn("w_scene", scenes)
    assert plain.count() == 3000 and plain.filter(" and ".join(f"{n} = w_{n}" for n in numbers)).count() == 3000


def test_bucketed_numbers_repeated(spark):
    """Repeated line numbers, equal rows among them, are numbered one after the other; an empty table has none."""
    rows = spark.createDataFrame([("a", 1, "mia", "scene", "s")] * 3 + [("a", 1, "mia", None, "s"), ("a", 2, "mia", None, "s")],
                                 "id string, line_no long, person string, type string, season string")
    table = write_bucketed(rows, 2)
    got = Words.numbers_in_buckets(spark.table(table)).collect()
    assert sorted(r.total_line for r in got) == [1, 2, 3, 4, 5] and max(r.scene for r in got) == 3
    empty = write_bucketed(rows.limit(0), 2)
    assert Words.numbers_in_buckets(spark.table(empty)).count() == 0
    for name in (table, empty):
        spark.sql(f"DROP TABLE {name}")
