"""Two steps that keep an expensive expression from being evaluated again and again.

The optimizer moves a filter below the projection that makes its column, copying the
expression, and adds "array is not empty" filters below an explode. With regular expressions
over whole texts each copy costs a pass over the text. An outer generator stays where it is,
and so do filters on what it makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Sets a column, evaluated once per row however often it is used later."""
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.inline_outer(F.array(F.struct(value.alias(name)))))


def exploded(df: DataFrame, items: Column, item: str, number: str, keep: list[str]) -> DataFrame:
    """One row per array element, numbered from 1; the array is evaluated once."""
    rows = df.select(*keep, F.posexplode_outer(items).alias("_pos", item))
    numbered = rows.withColumn(number, (F.col("_pos") + 1).cast("long"))
    return numbered.filter(F.col("_pos").isNotNull()).drop("_pos")
