"""The lines table on storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.durable import durable, new_path

LINES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("person", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("season", T.StringType()),
        T.StructField("scene", T.LongType()),
        T.StructField("source_file", T.StringType()),
    ]
)


_CSV = {"header": True, "nullValue": "NA", "emptyValue": "", "escape": '"', "multiLine": True}


def write_lines(lines: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write lines, partitioned by season.

    The rebalance hint lets adaptive execution size the files: a season with most of the
    rows is split over many tasks, small ones share a task.
    """
    lines = lines.select(*[F.col(f.name).cast(f.dataType) for f in LINES.fields])
    writer = lines.hint("rebalance", "season").write.mode(mode).partitionBy("season").format(format)
    if format == "csv":
        writer = writer.options(**_CSV)
    writer.save(path)


def read_lines(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Read lines with their fixed schema. Seasons keep a leading zero, and empty text is NULL."""
    reader = spark.read.schema(LINES).format(format)
    if format == "csv":
        reader = reader.options(**_CSV)
    names = [f.name for f in LINES.fields]
    return reader.load(path).select(*names).withColumn("line", F.nullif(F.col("line"), F.lit("")))


# Lines of an id that lie in one bucket, by line number: an id of any length is spread over buckets.
PART_LINES = 4096


def write_bucketed(lines: DataFrame, buckets: int, table: str | None = None, path: str | None = None, part_lines: int = PART_LINES) -> str:
    """Write lines as a table bucketed by (id, part) and sorted by line number, one file a bucket; returns its name.

    ``part`` is the line number divided by ``part_lines``, so a bucket never has to take a whole long id. What reads the
    table by id and part moves no line. A name and a path in the shared folder are made where none is given.
    """
    table = table or f"lines_{uuid.uuid4().hex}"
    part = F.floor(F.col("line_no") / part_lines).cast("long")
    rows = lines.withColumn("part", part).repartition(buckets, "id", "part")
    writer = rows.write.bucketBy(buckets, "id", "part").sortBy("id", "part", "line_no")
    writer.option("path", path or new_path(lines.sparkSession, "buckets")).saveAsTable(table)
    return table


BAD = "bad_row"


def write_rows(rows: DataFrame, path: str, season: str) -> None:
    """Rows as they are, one text column, into a season's folder of a CSV table, under its header."""
    header = ",".join(f.name for f in LINES.fields if f.name != "season")
    rows.select(F.col(rows.columns[0]).alias(header)).write.options(header=True, sep="\u0001", escapeQuotes=False).csv(f"{path}/season={season}")


def read_lines_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The lines of a CSV table, and its malformed rows as they are written: (bad_row, season).

    A row is malformed when it has other than the table's columns, or a value that is not of its type. A type that
    is missing stays a missing type: only malformed rows go. Both come from one schema with a column for
    what could not be read, so a count of the bad rows and the good lines add up to all rows.
    """
    schema = T.StructType([*[f for f in LINES.fields if f.name != "season"], T.StructField("season", T.StringType()), T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(schema).format("csv").options(**_CSV).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    # all columns are parsed, once: a row is only seen to be malformed where the columns at fault are read
    rows = durable(reader.load(path), "parsed")
    good = rows.filter(F.col(BAD).isNull()).drop(BAD).select(*[f.name for f in LINES.fields])
    good = good.withColumn("line", F.nullif(F.col("line"), F.lit("")))
    return good, rows.filter(F.col(BAD).isNotNull()).select(BAD, "season")
