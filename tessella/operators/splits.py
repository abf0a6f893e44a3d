"""Leakage-free group splits, their validation, and the joins that use them."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("seed", "train_size", "val_size", "test_size", "total_biopsies", "train", "val", "test")
#: Groups up to which a permutation split is made on the driver.
MAX_GROUPS = 1_000_000


def _draw(items: list[str], share: float, seed: int) -> tuple[list[str], list[str]]:
    """(rest, drawn) by the permutation of a seeded legacy generator; the drawn part is rounded up."""
    n = math.ceil(share * len(items))
    order = np.random.RandomState(seed).permutation(len(items))
    return [items[i] for i in order[n:]], [items[i] for i in order[:n]]


def permutation_split(groups: list[str], train: float = 0.70, val: float = 0.15, seed: int = 42) -> dict[str, list[str]]:
    """train, val and test lists. None: empty; one: train; two: shuffled into train and val."""
    test = 1.0 - train - val
    groups, parts = list(groups), {"train": [], "val": [], "test": []}
    if test < 0:
        raise ValueError("train and val are over 1")
    if len(groups) == 2:
        random.Random(seed).shuffle(groups)
        return parts | {"train": groups[:1], "val": groups[1:]}
    if len(groups) < 2:
        return parts | {"train": groups}
    rest = groups
    if test > 0:
        rest, parts["test"] = _draw(rest, test, seed)
    if val > 0 and len(rest) > 1:
        rest, parts["val"] = _draw(rest, val / (train + val), seed + 1)
    return parts | {"train": rest}


def permutation_frame(spark: SparkSession, groups: DataFrame, column: str, **sizes) -> DataFrame:
    """(column, split) of the distinct groups; raises over MAX_GROUPS, where hash_split is the way."""
    names = [r[0] for r in groups.select(column).distinct().orderBy(column).limit(MAX_GROUPS + 1).collect()]
    if len(names) > MAX_GROUPS:
        raise ValueError(f"over {MAX_GROUPS} groups: use hash_split")
    rows = [(g, part) for part, members in permutation_split(names, **sizes).items() for g in members]
    return spark.createDataFrame(rows, f"{column} string, split string")


def hash_split(groups: DataFrame, column: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(column, split) by the rank of md5(group|seed) among the distinct groups.

    The rank is a global order over groups (not rows), of which there are few beside the data.
    """
    named = groups.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("h", F.md5(F.concat(F.col(column), F.lit(f"|{seed}"))))
    w = Window.orderBy("h", column)
    ranked = named.withColumn("rk", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    pos = F.col("rk") / F.col("n")
    return ranked.select(column, F.when(pos < train, "train").when(pos < train + val, "val").otherwise("test").alias("split"))


def rows_of_split(rows: DataFrame, splits: DataFrame, column: str, part: str) -> DataFrame:
    return rows.join(splits.filter(F.col("split") == part), column, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """What a resumed run still has to do, the first limit by name."""
    left = rows.join(done, column, "left_anti")
    return left.orderBy(column).limit(limit) if limit is not None else left


def shared_groups(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def shared_split(spark: SparkSession, a: DataFrame, b: DataFrame, column: str, **sizes) -> DataFrame:
    """(column, split) of the groups that both datasets have."""
    return permutation_frame(spark, shared_groups(a, b, column), column, **sizes)


def available(splits: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Members of a split that a dataset has."""
    return splits.join(present, column, "left_semi")


def overlaps(splits: DataFrame, column: str) -> DataFrame:
    """One row for each pair of parts: how many groups are in both."""
    parts = splits.groupBy(column).agg(*[F.max(F.when(F.col("split") == p, 1).otherwise(0)).alias(p) for p in ("train", "val", "test")])
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    sums = parts.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])
    return sums.select(F.inline(rows))


def missing_keys(present: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def load_checks(splits: DataFrame, files: DataFrame, datasets: tuple[str, ...], column: str) -> DataFrame:
    """One row for each check of the listed files (dataset, column, kind): every dataset has files, and some of each part of the
    split are there (a failure is an error); masks and indexes exist (a failure only warns)."""
    here = splits.join(files.select("dataset", column).distinct(), column).groupBy("dataset").agg(F.count_distinct("split").alias("parts"))
    have = files.groupBy("dataset").agg(F.count("*").alias("n"))
    named = splits.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    each = named.join(have, "dataset", "left").join(here, "dataset", "left").crossJoin(F.broadcast(splits.agg(F.count_distinct("split").alias("all"))))  # one row
    found = each.select(F.inline(F.array(
        F.struct(F.concat(F.lit("files of "), "dataset").alias("check"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"), F.lit(False).alias("warns")),
        F.struct(F.concat(F.lit("split of "), "dataset").alias("check"), (F.coalesce("parts", F.lit(0)) == F.col("all")).alias("ok"), F.lit(False).alias("warns")),
    )))
    kinds = files.agg(F.count_if(F.col("kind") == "mask").alias("masks"), F.count_if(F.col("kind") == "index").alias("indexes"))
    extra = kinds.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), (F.col(k) > 0).alias("ok"), F.lit(True).alias("warns")) for k in ("masks", "indexes")])))
    return found.unionByName(extra)


def checks(splits: DataFrame, tiles: DataFrame, column: str) -> DataFrame:
    """One row for each check of a dataset against its split: name, ok and whether a failure only warns."""
    shared = overlaps(splits, column).agg((F.sum("shared") == 0).alias("ok")).select(F.lit("disjoint").alias("check"), "ok", F.lit(False).alias("warns"))
    counted = splits.agg((F.count("*") > 0).alias("ok")).select(F.lit("not_empty").alias("check"), "ok", F.lit(False).alias("warns"))
    lost = splits.join(tiles.select(column).distinct(), column, "left_anti").agg((F.count("*") == 0).alias("ok")).select(F.lit("tiles_present").alias("check"), "ok", F.lit(True).alias("warns"))
    return shared.unionByName(counted).unionByName(lost)
