"""Primary and secondary tiles of objects, tile registries and coverage indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

MIN_COVERAGE = 60.0


def _best_two(pairs: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """(keys, carried, __1, __2): the two pairs of largest coverage, ties to the lowest tile_idx. One shuffle by key; what
    is gathered for a key are the tiles its object meets, bounded by the grid."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("c"), F.col("tile_idx").alias("i"))))
    best = pairs.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], order.alias("__o"))
    return best.withColumn("__1", F.get("__o", F.lit(0))).withColumn("__2", F.get("__o", F.lit(1))).drop("__o")


def primary_secondary(objects: DataFrame, pairs: DataFrame, keys: list[str], min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """objects with their best tiles; those without any pair get a centred tile and no secondary.

    pairs: keys, tile_idx, coverage (over zero). With a best of min_coverage or more the best tile is primary and the next
    secondary; else a tile centred on the object is primary (its coverage stands at 0 until it is known) and the best is
    secondary.
    """
    return _assign_from(objects.join(_best_two(pairs, keys, []), keys, "left"), min_coverage)


def ranked_assignment(pairs: DataFrame, keys: list[str], carried: list[str], min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """As primary_secondary, without a join, for objects that have a pair at all; carried columns come from the pairs."""
    return _assign_from(_best_two(pairs, keys, carried), min_coverage)


def _assign_from(best: DataFrame, min_coverage: float) -> DataFrame:
    """Columns of the assignment from the two best (negative coverage, tile) structs __1 and __2."""
    good = F.coalesce(-F.col("__1.c") >= min_coverage, F.lit(False))
    pick = lambda yes, no: F.when(good, yes).otherwise(no)
    zero = lambda c: F.coalesce(-c, F.lit(0.0))
    return (
        best.withColumn("primary_is_centered", ~good)
        .withColumn("primary_tile", F.when(good, F.col("__1.i")))
        .withColumn("primary_coverage", pick(zero(F.col("__1.c")), F.lit(0.0)))
        .withColumn("secondary_tile", pick(F.col("__2.i"), F.col("__1.i")))
        .withColumn("secondary_coverage", pick(zero(F.col("__2.c")), zero(F.col("__1.c"))))
        .drop("__1", "__2")
    )


def roles(pairs: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with role: primary on the object's own primary grid tile, secondary on every other it overlaps."""
    own = assigned.select(*keys, "primary_tile")
    return pairs.join(own, keys).withColumn("role", F.when(F.col("tile_idx") == F.col("primary_tile"), "primary").otherwise("secondary")).drop("primary_tile")


def sequential_id(slide: str, *order: str) -> Column:
    """Dense ids from 0 for each slide in the given order."""
    return F.row_number().over(Window.partitionBy(slide).orderBy(*order)) - 1


def dense_ids(df: DataFrame, group: str, order: list[str], name: str, parts: int) -> DataFrame:
    """df with sequential_id() for groups of any size: rows are dealt by ranges of (group, order), so that a large group
    is spread over many tasks; an id is the place inside its range plus the rows of the group's ranges before it."""
    placed = cut_lineage(df.repartitionByRange(parts, group, *order).withColumn("__p", F.spark_partition_id()))
    sizes = placed.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(before, F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order)) - 1
    joined = placed.withColumn("__place", place).join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn(name, (F.col("__first") + F.col("__place")).cast("bigint")).drop("__p", "__q", "__g", "__first", "__place")


def inverted(pairs: DataFrame, by: list[str], item: Column, name: str) -> DataFrame:
    """Sorted items of each group."""
    return pairs.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias(name))


def coverage_index(assigned: DataFrame) -> DataFrame:
    """The assignment as named columns, with percentages rounded to two places."""
    return assigned.select(
        "slide", "gid", "class_name", "primary_tile", "secondary_tile",
        F.round("primary_coverage", 2).alias("primary_coverage_pct"), F.round("secondary_coverage", 2).alias("secondary_coverage_pct"),
    )
