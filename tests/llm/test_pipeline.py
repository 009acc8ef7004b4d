"""The pipeline's stages, each on what the one before kept, and the named queries."""

import corpus_pipeline as P
import __spark_entry__ as driver
from pyspark.sql import functions as F
from scriptweave.llm.queries import ORACLE, QUERIES
from tests.check import compare, connect
from tests.llm.test_llm import brute_hits, linked, shingles

SF = "/root/testdata/sf0.001"


def test_registered():
    found = driver.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(found) and set(ORACLE) <= set(driver.oracle_sql())


def test_sql(spark):
    con = connect(SF)
    for name, sql in ORACLE.items():
        assert compare(QUERIES[name](spark, SF), con, sql) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("n_hit", F.lit(1))
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()

    distinct = stages["near_dedup"](spark, clean, SF).cache()
    sets = {r.doc_id: shingles(r.text, 5) for r in clean.select("doc_id", "text").collect()}
    keep = {i for i, c in linked(sets, 80).items() if i == c}
    assert distinct.columns == docs.columns and sorted(r.doc_id for r in distinct.collect()) == sorted(keep)

    safe = stages["decontamination"](spark, distinct, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = {r.doc_id for r in distinct.collect() if brute_hits(r.text, items)[1] == 0}
    assert safe.columns == docs.columns and {r.doc_id for r in safe.collect()} == expected

    mixed = stages["mixing"](spark, safe, SF).cache()
    assert mixed.columns == docs.columns and mixed.join(safe, "doc_id", "left_anti").count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3

    tokens = stages["token_files"](spark, mixed, SF)
    assert tokens.count() == mixed.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, "s"), (2, "", None), (None, "a b c d e f g", "s"), (3, "a b c d e f g", "s"), (3, "a b c d e f g", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = dict(P.STAGES)["near_dedup"](spark, docs, SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "None"]
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        docs.count()
