"""Segmentation scores and summaries of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("iou", "f1", "precision", "recall")


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def binary_scores(df: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """IoU, F1, precision and recall of pred > 0 against truth > 0; zero where a denominator is."""
    t, p = F.col(truth) > 0, F.col(pred) > 0
    counted = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counted.select(*by, "tp", "fp", "fn", _share(tp, tp + fp + fn).alias("iou"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"))


def macro(scores: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted means of the scores, with the rows behind them."""
    return scores.groupBy(*by).agg(F.count("*").alias("num"), *[F.avg(s).alias(s) for s in SCORES])


def across(per_group: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each score over groups."""
    return per_group.agg(*[f(s).alias(f"{n}_{s}") for s in SCORES for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def mean_iou(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """IoU of each class that occurs; a row counts for its truth and its prediction."""
    both = df.select(F.explode(F.array_distinct(F.array(truth, pred))).alias("cls"), truth, pred)
    hit = F.count_if((F.col(truth) == F.col("cls")) & (F.col(pred) == F.col("cls")))
    return both.groupBy("cls").agg(hit.alias("inter"), F.count("*").alias("uni")).withColumn("iou", F.col("inter") / F.col("uni"))


def class_pivot(df: DataFrame, by: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of the given values by group, zero where none, with their sum."""
    wide = df.groupBy(by).pivot(column, list(values)).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(v) for v in values), F.lit(0).cast("bigint")))


def production_totals(df: DataFrame, group: str, tile: str) -> DataFrame:
    """Groups, tiles and rows, and rows a group (0 without groups)."""
    got = df.agg(F.count_distinct(group).alias("groups"), F.count_distinct(tile).alias("tiles"), F.count("*").alias("objects"))
    return got.withColumn("per_group", _share(F.col("objects"), F.col("groups")))


def run_report(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))
