"""Small tables: given in code, or read from a path."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

STOP_WORDS = T.StructType([T.StructField("word", T.StringType())])
LEX_SCORE = T.StructType([T.StructField("word", T.StringType()), T.StructField("score", T.IntegerType())])
LEX_SENTIMENT = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("sentiment", T.StringType())]
)
ALIASES = T.StructType([T.StructField("alias", T.StringType()), T.StructField("full_name", T.StringType())])
DISPLAY_NAMES = T.StructType(
    [T.StructField("person", T.StringType()), T.StructField("display", T.StringType())]
)
PAY = T.StructType(
    [
        T.StructField("season", T.StringType()),
        T.StructField("pay", T.DoubleType()),
        T.StructField("pay_adj", T.DoubleType()),
        T.StructField("n_groups", T.DoubleType()),
    ]
)

_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table from Python rows. Made by way of Arrow, it is a local relation of known size,
    so Spark itself decides whether to broadcast it."""
    columns = {
        f.name: pa.array([r[i] for r in rows], _ARROW[f.dataType.simpleString()])
        for i, f in enumerate(schema.fields)
    }
    return spark.createDataFrame(pa.table(columns), schema)


def read_lexicon(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    """A lexicon from Parquet or from CSV with a header, with a fixed schema."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if format == "csv" else reader.format(format).load(path)
