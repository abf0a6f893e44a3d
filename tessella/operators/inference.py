"""Detection and classification around a pluggable model: a function from a batch of arrays to a batch of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalars import argmax, pad_box, softmax, tile_to_native
from ..runtime import ship
from .raster import color_transfer, resize, resize_nearest, separate

EPS = 1e-6


def preprocess(raw: np.ndarray, height: int, width: int, side: int = 288) -> np.ndarray:
    """Colour transfer, linear resize and z-score over the whole image: float32 (3, side, side)."""
    small = resize(color_transfer(raw, height, width), side, side, "linear").astype(np.float32)
    return ((small - small.mean()) / (small.std() + EPS)).transpose(2, 0, 1)


def linear_model(weights: np.ndarray, bias: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in model: a linear scorer of channel means (trained weights aren't part of this library)."""
    return lambda batch: batch.reshape(len(batch), weights.shape[1], -1).mean(axis=2) @ weights.T + bias


def predict(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], data: str, height: str, width: str, side: int = 288, batch_size: int = 16) -> DataFrame:
    """df with logits (array of double): the model runs on mini-batches inside each Arrow batch.

    A row that can't be read gets null logits; the others go on.
    """
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("logits", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in (data, height, width)), strict=True))
            out: list = [None] * len(rows)
            good = [i for i, (d, h, w) in enumerate(rows) if d is not None and h and w and len(d) == h * w * 3]
            for k in range(0, len(good), batch_size):
                part = good[k : k + batch_size]
                stack = np.stack([preprocess(np.frombuffer(rows[i][0], np.uint8), rows[i][1], rows[i][2], side) for i in part])
                for i, row in zip(part, model(stack), strict=True):
                    out[i] = row.astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "logits"])

    return df.mapInArrow(run, schema)


INSTANCE = "label int, area bigint, x_min int, y_min int, x_max int, y_max int"


def segment(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], keys: list[str], data: str, height: str, width: str, side: int = 288, least: int = 1500, threshold: float = 0.5) -> DataFrame:
    """(keys, instance columns): objects of each tile. The model maps (n, 3, side, side) to (n, side, side) logits.

    A pixel is set if the sigmoid of its logit is over threshold; masks go back to the tile's size by nearest pixels,
    touching objects are separated, and those of under least pixels go. A tile that can't be read gives none.
    """
    ship(df.sparkSession)
    slim = df.select(*keys, F.col(data).alias("__data"), F.col(height).alias("__h"), F.col(width).alias("__w"))
    schema = StructType([*df.select(*keys).schema.fields, *StructType.fromDDL(INSTANCE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, found = [], []
            columns = zip(*(batch.column(c).to_pylist() for c in ("__data", "__h", "__w")), strict=True)
            for i, (raw, h, w) in enumerate(columns):
                if raw is None or not h or not w or len(raw) != h * w * 3:
                    continue
                logits = model(preprocess(np.frombuffer(raw, np.uint8), h, w, side)[None])[0]
                label = separate(resize_nearest(1 / (1 + np.exp(-logits)) > threshold, h, w))
                for k in range(1, label.max() + 1):
                    ys, xs = np.nonzero(label == k)
                    if len(ys) >= least:
                        taken.append(i)
                        found.append((k, len(ys), xs.min(), ys.min(), xs.max(), ys.max()))
            made = [pa.array([int(f[j]) for f in found], t) for j, t in enumerate((pa.int32(), pa.int64(), *[pa.int32()] * 4))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(taken, pa.int64())) for c in keys), *made], names=schema.names)

    return slim.mapInArrow(run, schema)


def classifier_input(crop: np.ndarray, mask: np.ndarray, side: int = 128) -> np.ndarray:
    """(4, side, side) float input of the classifier: a colour crop, resized and standardised as a whole, and its mask (0 or 255)."""
    rgb = np.clip(resize_linear(crop.astype(np.float64) / 255, side, side), 0, 1)
    scaled = (rgb - rgb.mean()) / (rgb.std() + 1e-6)
    return np.concatenate([scaled, resize_linear(mask[:, :, None] / 255, side, side)], axis=2).transpose(2, 0, 1).astype(np.float32)


def resize_linear(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples of a float image at pixel centres, without smoothing when it shrinks."""

    def spots(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        low = np.minimum(at.astype(int), max(0, m - 2))
        return low, np.minimum(low + 1, m - 1), at - low

    y0, y1, fy = spots(height, a.shape[0])
    x0, x1, fx = spots(width, a.shape[1])
    rows = a[y0] * (1 - fy)[:, None, None] + a[y1] * fy[:, None, None]
    return rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]


def classified(df: DataFrame, logits: str, names: tuple[str, ...]) -> DataFrame:
    """df with class_id, class and confidence; the first of equal scores wins."""
    p = softmax(F.col(logits))
    return df.withColumn("__p", p).withColumn("class_id", argmax(F.col("__p"))).withColumn("class", F.get(F.array(*map(F.lit, names)), F.col("class_id"))).withColumn("confidence", F.array_max("__p")).drop("__p")


def detections(instances: DataFrame, tile_x: Column, tile_y: Column, side: int, pad: int = 10, pixel_scale: float = 1.0) -> DataFrame:
    """instances (x_min..y_max inclusive px) with the padded box in the tile and its native coordinates."""
    box = pad_box(F.col("x_min"), F.col("y_min"), F.col("x_max"), F.col("y_max"), F.lit(side), F.lit(side), pad)
    boxed = instances.withColumn("bbox_tile", box)
    at = lambda o, c: tile_to_native(o, F.col(f"bbox_tile.{c}"), pixel_scale).cast("int").alias(c)
    return boxed.withColumn("bbox_native", F.struct(at(tile_x, "x0"), at(tile_y, "y0"), at(tile_x, "x1"), at(tile_y, "y1")))


def merge_duplicates(found: DataFrame, cell: int = 256) -> DataFrame:
    """Extension: detections (slide, det, x0..y1, confidence) without those whose centre lies in a better one's box.

    Objects seen in two overlapping tiles would count twice. Centres meet boxes on equal lattice cells.
    """
    centre = lambda a, b: (F.col(a) + F.col(b)) / 2
    points = found.select("slide", F.col("det").alias("d2"), F.col("confidence").alias("c2"), centre("x0", "x1").alias("px"), centre("y0", "y1").alias("py"))
    points = points.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    spans = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    boxes = found.withColumn("cx", spans("x0", "x1")).withColumn("cy", spans("y0", "y1"))
    inside = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    better = F.struct(F.col("confidence"), -F.col("det")) > F.struct(F.col("c2"), -F.col("d2"))
    worse = boxes.join(points, ["slide", "cx", "cy"]).filter(inside & better).select("slide", F.col("d2").alias("det")).distinct()
    return found.join(worse, ["slide", "det"], "left_anti")
