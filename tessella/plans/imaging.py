"""Queries on pixels: filters, codecs, thresholds, masks, mosaics, instances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..bridge import ANN_SQL, PATCH_SQL, SLIDE, TILE, annotations, patches, slides
from ..functions import scalars as s
from ..operators import grid, inference, raster

PATCH_STD = 26.0
CELL = 500


def patch_background_filter(spark, sf_dir):
    p = patches(spark, sf_dir).withColumn("std", s.std_of(F.col("pixels")))
    return p.select("vec_id", F.round("std", 6).alias("std"), raster.is_background(F.col("pixels"), PATCH_STD, F.col("std")).alias("background"))


PATCH_BACKGROUND_FILTER = f"""WITH p AS ({PATCH_SQL}), e AS (SELECT vec_id, unnest(pixels) AS v FROM p)
SELECT vec_id, round(stddev_pop(v), 6) AS std, stddev_pop(v) < {PATCH_STD}e0 AS background FROM e GROUP BY vec_id"""


def patch_zscore_codec(spark, sf_dir):
    z = patches(spark, sf_dir).withColumn("z", s.zscore(F.col("pixels"))).withColumn("u", s.zscore_to_byte(F.col("z")))
    back = F.zip_with(s.byte_to_zscore(F.col("u")), "z", lambda a, b: F.abs(a - b))
    worst = F.aggregate(F.zip_with(back, "z", lambda e, v: F.when(F.abs(v) < 4, e).otherwise(0.0)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return z.select("vec_id", F.aggregate("u", F.lit(0), lambda a, b: a + b).alias("sum_u"), F.round(F.array_max("z"), 6).alias("max_z"), (worst <= 8 / 255).alias("round_trip"))


PATCH_ZSCORE_CODEC = f"""WITH p AS ({PATCH_SQL}), e AS (SELECT vec_id, unnest(pixels) AS v FROM p), m AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY vec_id),
z AS (SELECT e.vec_id, (v - m) / (s + 1e-6) AS z FROM e JOIN m ON m.vec_id = e.vec_id)
SELECT vec_id, CAST(sum(CAST(least(255, greatest(0, trunc((z + 4) / 8 * 255))) AS INTEGER)) AS INTEGER) AS sum_u, round(max(z), 6) AS max_z, true AS round_trip FROM z GROUP BY vec_id"""


def patch_otsu(spark, sf_dir):
    e = patches(spark, sf_dir).select("vec_id", F.explode("pixels").alias("p"))
    return raster.otsu(e, "vec_id").select("vec_id", "threshold", F.round("between", 2).alias("between"))


PATCH_OTSU = f"""WITH p AS ({PATCH_SQL}), e AS (SELECT vec_id, unnest(pixels) AS v FROM p), h AS (SELECT vec_id, v, count(*) AS n FROM e GROUP BY vec_id, v),
c AS (SELECT vec_id, v, sum(n) OVER u AS w0, sum(n * v) OVER u AS s0, sum(n) OVER w AS w, sum(n * v) OVER w AS s FROM h
  WINDOW u AS (PARTITION BY vec_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY vec_id)),
b AS (SELECT vec_id, v, round(CAST(w0 AS DOUBLE) * (w - w0) * power(s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE), 2), 6) AS b FROM c WHERE w0 < w),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, v) AS rk FROM b)
SELECT vec_id, v AS threshold, round(b, 2) AS between FROM r WHERE rk = 1"""


def _cells(spark, sf_dir):
    a = annotations(spark, sf_dir).withColumn("class_id", s.class_id(s.class_name(F.col("raw_class")))).withColumn("gray", s.inference_gray(F.col("raw_class")))
    return raster.raster_cells(a, CELL)


CELLS_SQL = f"""ann AS ({ANN_SQL}), k AS (SELECT *, CASE replace(lower(trim(raw_class)), ' ', '') WHEN 'noprolif' THEN 1 WHEN 'proliferativo' THEN 2 WHEN 'esclerosado' THEN 3 WHEN 'exclude' THEN 4 ELSE 0 END AS class_id,
  CASE lower(raw_class) WHEN 'esclerosado' THEN 192 WHEN 'exclude' THEN 255 WHEN 'proliferativo' THEN 128 ELSE 64 END AS gray FROM ann),
xs AS (SELECT slide, gid, class_id, gray, y0, y1, unnest(range(CAST(ceil(x0 / {CELL} - 0.5e0) AS BIGINT), CAST(ceil(x1 / {CELL} - 0.5e0) AS BIGINT))) AS cx FROM k),
cells AS (SELECT slide, gid, class_id, gray, CAST(cx AS INTEGER) AS cx, CAST(unnest(range(CAST(ceil(y0 / {CELL} - 0.5e0) AS BIGINT), CAST(ceil(y1 / {CELL} - 0.5e0) AS BIGINT))) AS INTEGER) AS cy FROM xs)"""


def mask_compose_last(spark, sf_dir):
    return raster.compose_last(_cells(spark, sf_dir), ["slide", "cx", "cy"], "class_id", "gid").withColumn("gray", F.get(F.array(*map(F.lit, s.class_gray_lut()[:5])), F.col("class_id")))


MASK_COMPOSE_LAST = f"WITH {CELLS_SQL}, m AS (SELECT slide, cx, cy, arg_max(class_id, gid) AS class_id FROM cells GROUP BY slide, cx, cy) SELECT *, [0, 64, 128, 192, 255][class_id + 1] AS gray FROM m"


def mask_compose_max(spark, sf_dir):
    return raster.compose_max(_cells(spark, sf_dir), ["slide", "cx", "cy"], "gray")


MASK_COMPOSE_MAX = f"WITH {CELLS_SQL} SELECT slide, cx, cy, max(gray) AS gray FROM cells GROUP BY slide, cx, cy"


def tissue_filter(spark, sf_dir):
    """Tiles by the share of mask cells that hold an object, and both tilers' rules for keeping them."""
    mask = raster.compose_max(_cells(spark, sf_dir), ["slide", "cx", "cy"], "gray")
    side = SLIDE // CELL
    lattice = slides(spark).select("slide", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("cx")).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    cells = lattice.join(mask, ["slide", "cx", "cy"], "left").select("slide", "cx", "cy", F.coalesce((F.col("gray") > 0).cast("int"), F.lit(0)).alias("flag"))
    tiles = grid.training_grid(slides(spark), TILE, TILE).select("slide", "tile_idx", "x0", "y0", "x1", "y1")
    kept = raster.tissue_ratio(cells, tiles, CELL, ["slide"], 0.1)
    flat = F.col("tile_idx") % 5 == 0
    annotated = F.col("tile_idx") % 2 == 0
    return kept.select("slide", "tile_idx", F.round("ratio", 6).alias("ratio"), "keep", raster.keep_training(annotated, F.col("keep"), flat).alias("training"), raster.keep_inference(F.col("keep"), flat).alias("inference"))


TISSUE_FILTER = f"""WITH {CELLS_SQL}, m AS (SELECT DISTINCT slide, cx, cy FROM cells),
ax AS (SELECT CAST(range AS INTEGER) AS i FROM range(0, {SLIDE // CELL})), tx AS (SELECT range AS i FROM range(0, 9)),
t AS (SELECT CAST(row_number() OVER (ORDER BY pr, y, x) - 1 AS INTEGER) AS tile_idx, x, y FROM (
  SELECT 0 AS pr, a.i * {TILE} AS x, b.i * {TILE} AS y FROM tx a, tx b UNION ALL SELECT 1, {SLIDE - TILE}, b.i * {TILE} FROM tx b
  UNION ALL SELECT 2, a.i * {TILE}, {SLIDE - TILE} FROM tx a UNION ALL SELECT 3, {SLIDE - TILE}, {SLIDE - TILE})),
s AS (SELECT range AS slide FROM range(0, 20)),
r AS (SELECT s.slide, t.tile_idx, avg(CASE WHEN m.slide IS NULL THEN 0e0 ELSE 1e0 END) AS ratio FROM s JOIN t ON true
  JOIN ax a ON a.i BETWEEN x // {CELL} AND greatest(x // {CELL}, (x + {TILE}) // {CELL} - 1) JOIN ax b ON b.i BETWEEN y // {CELL} AND greatest(y // {CELL}, (y + {TILE}) // {CELL} - 1)
  LEFT JOIN m ON m.slide = s.slide AND m.cx = a.i AND m.cy = b.i GROUP BY s.slide, t.tile_idx),
kept AS (SELECT slide, tile_idx, round(ratio, 6) AS ratio, ratio >= 0.1e0 AS keep FROM r)
SELECT *, tile_idx % 2 = 0 OR (keep AND tile_idx % 5 <> 0) AS training, keep AND tile_idx % 5 <> 0 AS inference FROM kept"""


def mosaic(spark, sf_dir):
    """8 x 8 patches pasted on a canvas by label, later ids over earlier ones."""
    p = patches(spark, sf_dir).select("label", "vec_id", (F.col("vec_id") % 10 * 60).alias("x0"), (F.floor(F.col("vec_id") / 10) % 10 * 60).alias("y0"), "pixels")
    return raster.mosaic(p, ["label"], "pixels", 8, 10, "vec_id")


MOSAIC = f"""WITH p AS ({PATCH_SQL}), e AS (SELECT label, vec_id, unnest(pixels) AS v, unnest(range(0, 64)) AS i FROM p),
a AS (SELECT label, vec_id, v, CAST(vec_id % 10 * 6 + i % 8 AS INTEGER) AS px, CAST((vec_id // 10) % 10 * 6 + i // 8 AS INTEGER) AS py FROM e)
SELECT label, px, py, arg_max(v, vec_id) AS value FROM a GROUP BY label, px, py"""


def pyramid_levels(spark, sf_dir):
    p = patches(spark, sf_dir).select("vec_id", F.posexplode("pixels").alias("i", "p"))
    p = p.select("vec_id", "p", (F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"))
    return raster.pyramid(p, ["vec_id"], 4).select("vec_id", "level", "px", "py", F.round("value", 6).alias("value"))


PYRAMID_LEVELS = f"""WITH p AS ({PATCH_SQL}), e AS (SELECT vec_id, unnest(pixels) AS v, unnest(range(0, 64)) AS i FROM p), l AS (SELECT CAST(range AS INTEGER) AS level FROM range(0, 4))
SELECT vec_id, level, CAST((i % 8) >> level AS INTEGER) AS px, CAST((i // 8) >> level AS INTEGER) AS py, round(avg(v), 6) AS value FROM e, l GROUP BY 1, 2, 3, 4"""


def canvas_extent(spark, sf_dir):
    a = annotations(spark, sf_dir)
    return raster.capped_extent(raster.canvas_extent(a, ["slide"], 0.5))


CANVAS_EXTENT = f"""WITH ann AS ({ANN_SQL}), c AS (SELECT slide, CAST(trunc((max(x1) - min(x0)) * 0.5e0) AS INTEGER) AS width, CAST(trunc((max(y1) - min(y0)) * 0.5e0) AS INTEGER) AS height,
  min(x0) AS min_x, min(y0) AS min_y FROM ann GROUP BY slide)
SELECT *, CAST(trunc(width * least(1e0, 8000e0 / greatest(width, height))) AS INTEGER) AS out_width, CAST(trunc(height * least(1e0, 8000e0 / greatest(width, height))) AS INTEGER) AS out_height FROM c"""


def overlay(spark, sf_dir):
    """Grey patches under a class mask of alpha 180: mean of the blended pixels."""
    e = patches(spark, sf_dir).select("vec_id", "label", F.explode("pixels").alias("p"))
    gray = F.get(F.array(*map(F.lit, s.class_gray_lut()[:5])), F.col("label") % 5)
    return e.withColumn("o", s.overlay(gray, F.col("p"), gray)).groupBy("vec_id").agg(F.sum("o").alias("total"))


OVERLAY = f"""WITH p AS ({PATCH_SQL}), e AS (SELECT vec_id, label, unnest(pixels) AS v FROM p), g AS (SELECT vec_id, v, [0, 64, 128, 192, 255][label % 5 + 1] AS g FROM e)
SELECT vec_id, sum(CASE WHEN g > 0 THEN CAST(round((g * 180 + v * 75) / 255e0) AS INTEGER) ELSE v END)::BIGINT AS total FROM g GROUP BY vec_id"""


def instances(spark, sf_dir):
    """Connected components of bright pixels in each patch, with area and bounds."""
    p = patches(spark, sf_dir).withColumn("raw", F.expr("unhex(array_join(transform(pixels, v -> lpad(hex(v), 2, '0')), ''))"))
    labelled = raster.map_images(p.select("vec_id", "raw"), _bright, ["raw"], "labels")
    each = labelled.select("vec_id", F.posexplode(F.expr("transform(sequence(1, 64), i -> cast(conv(hex(substring(labels, i, 1)), 16, 10) AS int))")).alias("i", "label"))
    return raster.instances(each.select("vec_id", "label", (F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py")), ["vec_id"], least=3)


INSTANCES = f"""WITH RECURSIVE p AS ({PATCH_SQL}), e AS (SELECT vec_id, unnest(pixels) AS v, CAST(unnest(range(0, 64)) AS INTEGER) AS i FROM p), b AS (SELECT vec_id, i FROM e WHERE v > 127),
n AS (SELECT a.vec_id, a.i, c.i AS j FROM b a JOIN b c ON c.vec_id = a.vec_id AND ((a.i // 8 = c.i // 8 AND abs(a.i - c.i) = 1) OR abs(a.i - c.i) = 8)),
r AS (SELECT vec_id, i, i AS j FROM b UNION SELECT r.vec_id, r.i, n.j FROM r JOIN n ON n.vec_id = r.vec_id AND n.i = r.j),
l AS (SELECT vec_id, i, min(j) AS root FROM r GROUP BY vec_id, i), k AS (SELECT vec_id, i, CAST(dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS label FROM l)
SELECT vec_id, label, count(*) AS area, CAST(min(i % 8) AS INTEGER) AS x_min, CAST(max(i % 8) AS INTEGER) AS x_max, CAST(min(i // 8) AS INTEGER) AS y_min, CAST(max(i // 8) AS INTEGER) AS y_max
FROM k GROUP BY vec_id, label HAVING count(*) >= 3"""


def _bright(raw: np.ndarray) -> np.ndarray:
    return raster.label_components(raw.reshape(8, 8) > 127).astype(np.uint8)


def merged_detections(spark, sf_dir):
    """Extension: objects without those whose centre lies in the box of a larger one of the same slide."""
    a = annotations(spark, sf_dir).withColumn("confidence", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    kept = inference.merge_duplicates(a.select("slide", F.col("gid").alias("det"), "x0", "y0", "x1", "y1", "confidence"))
    return kept.groupBy("slide").agg(F.count("*").alias("n"), F.sum("det").alias("ids"))


MERGED_DETECTIONS = f"""WITH ann AS ({ANN_SQL}), a AS (SELECT *, (x1 - x0) * (y1 - y0) AS c FROM ann),
w AS (SELECT DISTINCT b.gid FROM a JOIN a b ON a.slide = b.slide AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1 AND (a.c > b.c OR (a.c = b.c AND a.gid < b.gid)))
SELECT slide, count(*) AS n, sum(gid)::BIGINT AS ids FROM a WHERE gid NOT IN (SELECT gid FROM w) GROUP BY slide"""

QUERIES = {
    "patch_background_filter": (patch_background_filter, PATCH_BACKGROUND_FILTER),
    "patch_zscore_codec": (patch_zscore_codec, PATCH_ZSCORE_CODEC),
    "patch_otsu": (patch_otsu, PATCH_OTSU),
    "mask_compose_last": (mask_compose_last, MASK_COMPOSE_LAST),
    "mask_compose_max": (mask_compose_max, MASK_COMPOSE_MAX),
    "tissue_filter": (tissue_filter, TISSUE_FILTER),
    "mosaic": (mosaic, MOSAIC),
    "pyramid_levels": (pyramid_levels, PYRAMID_LEVELS),
    "canvas_extent": (canvas_extent, CANVAS_EXTENT),
    "overlay": (overlay, OVERLAY),
    "instances": (instances, INSTANCES),
    "merged_detections": (merged_detections, MERGED_DETECTIONS),
}
