"""Size statistics, percentiles, tile recommendations, histograms and class shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import recommended_tile
from ..runtime import cut_lineage

PERCENTILES = (50, 75, 85, 90, 95)
#: Ranges of values in which a group's rows are counted for its percentiles.
RANGES = 4096


def spread(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """min, max, mean and sample standard deviation (null for one row) of columns."""
    aggregates = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *aggregates)


def percentiles(df: DataFrame, column: str, by: list[str], points: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Exact percentiles with linear interpolation, one row for each group and point; nulls are left out.

    Equal values are counted, and these counts summed in RANGES equal ranges between a group's extremes, from which follows in which ranges the ranks of the
    points lie. Only those ranges' distinct values are ordered, each range on its own, so no group is sorted or merged as a
    whole.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__x")).agg(F.count("*").alias("__k"))
    values = cut_lineage(values)
    ends = values.groupBy(*by).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.sum("__k").alias("__n"))
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(RANGES - 1), F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES))).otherwise(0)
    counts = values.join(ends, by).select(*by, "__x", "__k", at.alias("__r"))
    ranges = counts.groupBy(*by, "__r").agg(F.sum("__k").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("__first", before).select(*by, "__r", "__first", (F.col("__first") + F.col("__k")).alias("__last"))
    rank = (F.col("__n") - 1) * F.col("pct") / 100.0
    wanted = ends.withColumn("pct", F.explode(F.array(*map(F.lit, points)))).withColumn("__rank", rank).withColumn("__low", F.floor(rank)).withColumn("__high", F.ceil(rank))
    return _at_ranks(counts, placed, wanted, by)


def _at_ranks(counts: DataFrame, placed: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The values at the ranks __low and __high of wanted, interpolated."""
    need = wanted.select(*by, "pct", F.explode(F.array("__low", "__high")).alias("__at"))
    spot = need.join(placed, by).filter("__at >= __first AND __at < __last").select(*by, "pct", "__at", "__r", "__first")
    mine = counts.join(spot.select(*by, "__r").distinct(), [*by, "__r"], "left_semi")
    upto = F.sum("__k").over(Window.partitionBy(*by, "__r").orderBy("__x"))
    ordered = mine.withColumn("__upto", upto)
    met = spot.join(ordered, [*by, "__r"]).filter("__at - __first >= __upto - __k AND __at - __first < __upto").groupBy(*by, "pct", "__at").agg(F.max("__x").alias("__v"))
    each = wanted.select(*by, "pct", "__rank", "__low", "__high").join(met, [*by, "pct"])
    low, high = (F.max(F.when(F.col("__at") == F.col(c), F.col("__v"))) for c in ("__low", "__high"))
    both = each.groupBy(*by, "pct", "__rank", "__low").agg(low.alias("__a"), high.alias("__b"))
    return both.select(*by, "pct", (F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__rank") - F.col("__low"))).alias("value"))


def recommendation(df: DataFrame, column: str, by: list[str], points: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """For each group and percentile: the recommended tile, the share of rows it holds, and how many are covered. Rows meet one
    row of their group, which holds the tiles of all points, and are counted once."""
    sizes = percentiles(df, column, by, points).withColumn("tile", recommended_tile(F.col("value")))
    tiles = sizes.groupBy(*by).agg(*[F.max(F.when(F.col("pct") == p, F.col("tile"))).alias(f"__t{p}") for p in points])
    fits = df.join(tiles, by).groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) <= F.col(f"__t{p}")).alias(f"__f{p}") for p in points])
    hits = fits.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("pct"), F.col(f"__f{p}").alias("__fit")) for p in points])).alias("__e")).select(*by, "n", "__e.*")
    covered = F.ceil(F.col("n") * F.col("pct") / 100).cast("bigint")
    return sizes.join(hits, [*by, "pct"]).select(*by, "pct", "value", "tile", "n", (F.col("__fit") * 100.0 / F.col("n")).alias("fit_pct"), covered.alias("covered"), (F.col("n") - covered).alias("incomplete"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each of bins equal bins from low to high; the last is closed. Values below are in bin -1, values above in bin bins."""
    x = F.col(column)
    at = F.when(x < low, -1).when(x > high, bins).otherwise(F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)))).cast("int")
    return df.filter(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def trend(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares line of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def share(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value. The total is summed over the groups' counts."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def class_counts(df: DataFrame, by: str, bucket: Column, names: tuple[str, ...]) -> DataFrame:
    """Total and one column for each bucket by group; rows in no bucket count in the total alone."""
    return df.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(bucket == n).alias(n.lower()) for n in names])


def with_empty(counts: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """counts with a row of zeros for each group that has none."""
    numbers = [c for c in counts.columns if c != by]
    return groups.select(by).distinct().join(counts, by, "left").na.fill(0, numbers)


def text_report(stats: DataFrame, by: str, few: int = 10) -> DataFrame:
    """One line for each percentile row, with a warning for small samples and a conservative size from the maximum."""
    line = F.format_string("P%d: %.2f px -> tile %d (%.1f%% fit)", "pct", "value", "tile", "fit_pct")
    warning = F.when(F.col("n") < few, F.format_string(" [only %d objects]", "n")).otherwise("")
    return stats.select(by, "pct", F.concat(line, warning).alias("line"))


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """Inverse-frequency weights: total / (classes * count)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))
