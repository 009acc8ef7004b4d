"""Who is on stage with whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .durable import durable

_BITS = 63
CAST_BLOCK = 128


def _masks(main: list[str], person: str) -> list[Column]:
    """Per 63 speakers one long whose bit i says that speaker i occurs."""
    masks = []
    for start in range(0, len(main), _BITS):
        place = F.array_position(F.lit(main[start : start + _BITS]), F.col(person)).cast("int")
        bit = F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), place - 1))
        masks.append(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias(f"_mask{start // _BITS}"))
    return masks


def _flag(i: int) -> str:
    """1 when speaker i is present, else 0."""
    return f"(shiftright(_mask{i // _BITS}, {i % _BITS}) & 1)"


def _presence(df: DataFrame, main: list[str], scene: list[str], person: str) -> DataFrame:
    """Who of the main speakers occurs in each scene: a few longs per scene."""
    return df.filter(F.col(person).isin(main)).groupBy(*scene).agg(*_masks(main, person))


def presence_matrix(
    lines: DataFrame, main: list[str], scene: list[str] = ["id", "scene"], person: str = "person"
) -> DataFrame:
    """Per scene one column per main speaker: 1 when present, else 0."""
    flags = [F.expr(_flag(i)).alias(p) for i, p in enumerate(main)]
    return _presence(lines, main, scene, person).select(*scene, *flags)


def cooccurrence(
    lines: DataFrame, main: list[str], scene: list[str] = ["id", "scene"], person: str = "person"
) -> DataFrame:
    """Scenes shared by each two main speakers that occur, zero included, person_a > person_b.

    This is the presence matrix times its transpose. Scenes with the same cast are counted
    first; then each speaker of a cast adds that count to all its cast's columns. No scene
    is joined with itself. Every two of ``main`` make a row and a sum column each, as the report asks of
    a given cast of speakers: keep the list to tens.
    """
    presence = _presence(lines, main, scene, person)
    mask_names = [c for c in presence.columns if c not in scene]
    casts = presence.groupBy(*mask_names).agg(F.count(F.lit(1)).alias("n"))
    speakers = range(len(main))
    members = ", ".join(f"if({_flag(i)} = 1, {i}, null)" for i in speakers)
    rows = casts.withColumn("_a", F.explode(F.expr(f"array_compact(array({members}))")))
    shared = rows.groupBy("_a").agg(*[F.expr(f"sum({_flag(i)} * n) as _{i}") for i in speakers])
    # from here on at most len(main) rows
    columns = ", ".join(f"struct({i} as _b, _{i} as n)" for i in speakers)
    cells = shared.select("_a", F.expr(f"inline(array({columns}))"))
    names = F.lit(main)
    occurring = shared.select(F.col("_a").alias("_b"))
    return (
        cells.join(occurring, "_b")
        .select(F.get(names, F.col("_a")).alias("person_a"), F.get(names, F.col("_b")).alias("person_b"), "n")
        .filter(F.col("person_a") > F.col("person_b"))
    )


def cooccurrence_all(
    lines: DataFrame, scene: list[str] = ["id", "scene"], person: str = "person", block: int = CAST_BLOCK
) -> DataFrame:
    """Scenes shared by each two speakers that meet, person_a > person_b, for any number of speakers.

    Equal casts of up to ``block`` speakers are counted first, and the lower triangle of each is written out. The
    speakers of a larger cast are dealt into blocks of about that many, and each two blocks of it are a row of
    their own: no cast, however large, is gathered in one task or written out by one. Pairs that never meet
    have no row. Null speakers are left out, nulls in ``scene`` are a scene like any other.
    """
    members = durable(lines.filter(F.col(person).isNotNull()).select(F.struct(*scene).alias("_s"), F.col(person).alias("_p")).distinct(), "members")
    sizes = members.groupBy("_s").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    members = members.join(sizes, "_s")
    casts = members.filter(F.col("_size") <= block).groupBy("_s").agg(F.sort_array(F.collect_list("_p")).alias("_a"))
    casts = casts.groupBy("_a").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.col("_a"))

    large = members.filter(F.col("_size") > block).withColumn("_blocks", F.ceil(F.col("_size") / block).cast("int"))
    large = large.withColumn("_i", F.pmod(F.xxhash64("_p"), F.col("_blocks")).cast("int"))
    lists = durable(large.groupBy("_s", "_blocks", "_i").agg(F.collect_list("_p").alias("_a")), "blocks")
    first = lists.select("_s", F.col("_i").alias("_j"), F.col("_a").alias("_b"))
    both = lists.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).join(first, ["_s", "_j"])
    # the blocks meet once in each order, and one order of each two speakers is left
    rows = casts.select("_n", "_a", "_b").unionAll(both.select(F.lit(1).cast("long").alias("_n"), "_a", "_b"))
    pairs = rows.select("_n", "_a", F.explode("_b").alias("person_b")).select("_n", "person_b", F.explode("_a").alias("person_a"))
    return pairs.filter(F.col("person_a") > F.col("person_b")).groupBy("person_a", "person_b").agg(F.sum("_n").alias("n"))
