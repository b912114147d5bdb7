"""Interval joins: places (lines, findings, times) with the extents that hold them.

A join on ``start <= place <= end`` alone compares everything with everything of a key. Here extents are sorted into levels by
their length: one of level ``L`` is at most ``2^L`` long and so touches at most two bins of that width. It is written to
those, whatever its length, and a place looks into one bin of each level that the table has. Only every second level is used,
of which there are at most 32: a place is shuffled once for each, which is most of the bytes of the join.
So it is an equi-join on (key, level, bin), in which an extent has two rows at most and a place meets only extents
that begin or end near it, near as measured by their own length. Bins of high levels, where one extent meets many
places, are split: the extent is written once for each part, the places are dealt over the parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = 12  # bins of up to 2^12 places are not split


def _level(start: Column, end: Column) -> Column:
    """The least even level whose bins are as wide as the extent is long."""
    length = (end - start + 1).cast("long")
    bits = F.when(length <= 1, 0).otherwise(F.length(F.conv((length - 1).cast("string"), 10, 2))).cast("int")
    return (bits + bits % 2).cast("int")


def _parts(level: Column) -> Column:
    return F.pow(F.lit(2), F.greatest(level - WHOLE, F.lit(0))).cast("long")


def holding(
    places: DataFrame, extents: DataFrame, keys: Sequence[str], place: str = "line_number", start: str = "start_line", end: str = "end_line",
) -> DataFrame:
    """Each row of ``places`` with each row of ``extents`` of equal ``keys`` whose stretch holds it: all columns of both, keys once.

    Ends are inside. Nulls in keys or ends meet nothing, nor do extents that end before they begin; repeated rows meet as often
    as they stand there. Names that both sides have, but for the keys, are not allowed.
    """
    keys = list(keys)
    clash = (set(places.columns) & set(extents.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    inner = F.col("_e")
    ends = [inner[start].cast("long"), inner[end].cast("long")]
    sized = extents.select(F.struct(*[F.col(f"`{c}`") for c in extents.columns]).alias("_e")).where(ends[0] <= ends[1])
    level = sized.withColumn("_level", _level(*ends))
    # the levels that there are: at most 32 numbers
    levels = sorted(r["_level"] for r in level.select("_level").distinct().collect())
    width = F.pow(F.lit(2), F.col("_level")).cast("long")
    bins = F.array_distinct(F.transform(F.array(*ends), lambda e: F.floor(e / width).cast("long")))
    written = level.withColumn("_bin", F.explode(bins)).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("_level")) - 1)))
    on = [inner[k].alias(f"_k{i}") for i, k in enumerate(keys)]
    written = written.select(*on, "_level", "_bin", "_part", "_e")

    at = F.col("_p")[place].cast("long")
    looked = places.select(F.struct(*[F.col(f"`{c}`") for c in places.columns]).alias("_p")).where(at.isNotNull())
    looked = looked.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    looked = looked.select(
        *[F.col("_p")[k].alias(f"_k{i}") for i, k in enumerate(keys)], "_level", F.floor(at / width).cast("long").alias("_bin"),
        F.pmod(F.xxhash64(at), _parts(F.col("_level"))).alias("_part"), "_p",
    )
    met = looked.join(written, [f"_k{i}" for i in range(len(keys))] + ["_level", "_bin", "_part"])
    met = met.where((ends[0] <= at) & (at <= ends[1]))
    own = [F.col("_p")[c].alias(c) for c in places.columns]
    return met.select(*own, *[inner[c].alias(c) for c in extents.columns if c not in keys])


def innermost(
    places: DataFrame, extents: DataFrame, keys: Sequence[str], place: str = "line_number", start: str = "start_line", end: str = "end_line",
) -> DataFrame:
    """``keys, place, held_by`` and the columns of the innermost extent, for each distinct place that some extent holds.

    Innermost is the extent that begins last, of those the one that ends first, then the least by its other columns;
    ``held_by`` counts the extents around the place.
    """
    rest = [c for c in extents.columns if c not in (*keys, start, end)]
    distinct = places.select(*keys, place).distinct()
    met = holding(distinct, extents, keys, place, start, end)
    order = F.struct((-F.col(start).cast("long")).alias("o"), F.col(end).alias("e"), *[F.col(c) for c in rest])
    first = met.groupBy(*keys, place).agg(F.count("*").alias("held_by"), F.min(order).alias("_first"), F.max(start).alias(start))
    return first.select(*keys, place, "held_by", start, F.col("_first.e").alias(end), *[F.col("_first")[c].alias(c) for c in rest])
