"""Polygon geometry as array expressions: rings are array<struct<x: double, y: double>>, open or closed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..runtime import ship


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _next(ring: Column) -> Column:
    """The ring turned by one point: each point's successor."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    return F.zip_with(ring, _next(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def signed_area(ring: Column) -> Column:
    return let(ring, lambda r: F.coalesce(_sum(F.transform(edges(r), _cross)) / 2, F.lit(0.0)))


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def area_with_holes(rings: Column) -> Column:
    """The first ring less the others."""
    return let(F.transform(rings, area), lambda a: F.get(a, F.lit(0)) * 2 - _sum(a))


def perimeter(ring: Column) -> Column:
    length = lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    return let(ring, lambda r: _sum(F.transform(edges(r), length)))


def perimeter_with_holes(rings: Column) -> Column:
    """The length of all rings, the holes' too."""
    return _sum(F.transform(rings, perimeter))


def circularity(a: Column, p: Column) -> Column:
    """4 pi A / P^2, zero without a perimeter."""
    return F.when(p > 0, 4 * math.pi * a / (p * p)).otherwise(0.0)


def bounds(ring: Column) -> Column:
    xs, ys = ring["x"], ring["y"]
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid(ring: Column) -> Column:
    """Area centroid; the mean of the points if the ring has no area."""

    def of(es: Column) -> Column:
        c = F.transform(es, _cross)
        weighted = lambda k: _sum(F.transform(es, lambda e: (e["p"][k] + e["q"][k]) * _cross(e)))
        mean = lambda k: _sum(F.transform(es, lambda e: e["p"][k])) / F.size(es)
        return let(_sum(c), lambda s: F.struct(*[F.when(s != 0, weighted(k) / (3 * s)).otherwise(mean(k)).alias(k) for k in ("x", "y")]))

    return let(edges(ring), of)


def _clip_half(ring: Column, axis: str, bound: Column, keep_low: bool) -> Column:
    """The ring's part on one side of a line across axis."""
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] <= bound if keep_low else p[axis] >= bound

    def crossing(e: Column) -> Column:
        t = (bound - e["p"][axis]) / (e["q"][axis] - e["p"][axis])
        across = (e["p"][other] + t * (e["q"][other] - e["p"][other])).alias(other)
        along = bound.cast("double").alias(axis)
        return F.struct(along, across) if axis == "x" else F.struct(across, along)

    none = F.array().cast("array<struct<x:double,y:double>>")

    def step(e: Column) -> Column:
        own = F.when(inside(e["p"]), F.array(e["p"])).otherwise(none)
        cut = F.when(inside(e["p"]) != inside(e["q"]), F.array(crossing(e))).otherwise(none)
        return F.concat(own, cut)

    return F.flatten(F.transform(edges(ring), step))


def clip(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Intersection with a box, by four half-plane clips."""
    for axis, bound, low in (("x", x0, False), ("x", x1, True), ("y", y0, False), ("y", y1, True)):
        ring = let(ring, _half(axis, bound, low))
    return ring


def _half(axis: str, bound: Column, keep_low: bool) -> Callable[[Column], Column]:
    return lambda ring: _clip_half(ring, axis, bound, keep_low)


def coverage_pct(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Share of the ring's area inside a box, in percent; zero for a ring without area. A ring whose bounds are inside
    the box is not clipped."""

    def share(a: Column) -> Column:
        b = bounds(ring)
        whole = (b["x0"] >= x0) & (b["x1"] <= x1) & (b["y0"] >= y0) & (b["y1"] <= y1)
        return F.when(a <= 0, 0.0).when(whole, 100.0).otherwise(area(clip(ring, x0, y0, x1, y1)) / a * 100)

    return let(area(ring), share)


def clipped_areas(starts: np.ndarray, x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Areas of rings inside their boxes (columns x0, y0, x1, y1): points of ring i are x[starts[i] : starts[i + 1]]."""
    owner = np.repeat(np.arange(len(boxes)), np.diff(starts))
    for side, keep_low in ((0, False), (2, True), (1, False), (3, True)):
        along, across = (x, y) if side % 2 == 0 else (y, x)
        bound = boxes[owner, side]
        follows = np.arange(1, len(owner) + 1)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
        follows[last] = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        inside = along <= bound if keep_low else along >= bound
        cuts = inside != inside[follows]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (bound - along) / (along[follows] - along)
        crossing = across + t * (across[follows] - across)
        count = inside.astype(np.int64) + cuts
        at = np.cumsum(count) - count
        new_along, new_across = np.empty(count.sum()), np.empty(count.sum())
        new_along[at[inside]], new_across[at[inside]] = along[inside], across[inside]
        at = (at + inside)[cuts]
        new_along[at], new_across[at] = bound[cuts], crossing[cuts]
        owner = np.repeat(owner, count)
        x, y = (new_along, new_across) if side % 2 == 0 else (new_across, new_along)
    return np.abs(shoelaces(owner, x, y, len(boxes)))


def shoelaces(owner: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Signed areas of n rings whose points lie in a row, owner by owner."""
    if not len(owner):
        return np.zeros(n)
    follows = np.arange(1, len(owner) + 1)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    follows[last] = np.concatenate([[0], last[:-1] + 1])
    return np.bincount(owner, x * y[follows] - x[follows] * y, n) / 2


def with_coverage(pairs: DataFrame, ring: str, box: tuple[str, str, str, str], keep: list[str], name: str = "coverage") -> DataFrame:
    """keep and the share of each ring's area inside its box, in percent (coverage_pct() in Arrow batches, all rings of a batch at
    once). Null and empty rings, and rings without area, give zero."""
    ship(pairs.sparkSession)
    slim = pairs.select(*keep, F.transform(ring, lambda p: p["x"].cast("double")).alias("__x"), F.transform(ring, lambda p: p["y"].cast("double")).alias("__y"), F.array(*[F.col(c).cast("double") for c in box]).alias("__box"))
    schema = StructType([*slim.select(*keep).schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            xs = batch.column("__x")
            starts = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.list_value_length(xs), 0)))])
            x, y = (np.array(batch.column(c).flatten(), np.float64) for c in ("__x", "__y"))
            boxes = np.array(batch.column("__box").flatten(), np.float64).reshape(n, 4)
            whole = np.abs(shoelaces(np.repeat(np.arange(n), np.diff(starts)), x, y, n))
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(whole > 0, clipped_areas(starts, x, y, boxes) / whole * 100, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(share)], names=[*keep, name])

    return slim.mapInArrow(run, schema)


def clamp(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Each point moved into the box (no true clipping: shapes may distort)."""
    return F.transform(ring, lambda p: F.struct(F.greatest(x0, F.least(p["x"], x1)).alias("x"), F.greatest(y0, F.least(p["y"], y1)).alias("y")))


def box_overlap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Area that two boxes share."""
    return F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))


def crosses_itself(ring: Column) -> Column:
    """Whether two edges that share no point cross properly (such rings aren't repaired, only flagged)."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def cross(a: Column, b: Column) -> Column:
        return (side(a["p"], a["q"], b["p"]) * side(a["p"], a["q"], b["q"]) < 0) & (side(b["p"], b["q"], a["p"]) * side(b["p"], b["q"], a["q"]) < 0)

    return let(edges(ring), lambda es: F.exists(es, lambda a: F.exists(es, lambda b: cross(a, b))))
