"""Raster operators: thresholds, masks and mosaics as relational plans, pixel kernels in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..config import COLOR_MEANS, COLOR_STDS
from ..functions.scalars import std_of
from ..runtime import ship


def otsu(pixels: DataFrame, by: str, value: str = "p") -> DataFrame:
    """(by, threshold, between): the value (0 to 255) that best parts each group's histogram, the lowest of equals.

    Pixels are aggregated to at most 256 rows a group before any window runs.
    """
    h = pixels.groupBy(by, F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    c = h.select(
        by, "v",
        F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"),
        F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"),
    ).filter("w0 < w")
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1)
    scored = c.withColumn("between", F.round(between, 6))
    return scored.groupBy(by).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"), F.max("between").alias("between"))


def tissue_ratio(cells: DataFrame, tiles: DataFrame, cell: int, keys: list[str], least: float = 0.01) -> DataFrame:
    """tiles with ratio and keep: share of set mask cells (cx, cy, flag) inside a tile against least.

    A slide without a mask keeps its tiles (ratio null); a tile without any cell goes. Tiles are posted under their
    cells, so the join is on equal cells.
    """
    spans = tiles.withColumn("__cx", F.explode(F.expr(f"sequence(cast(x0 / {cell} AS int), greatest(cast(x0 / {cell} AS int), cast(x1 / {cell} AS int) - 1))")))
    spans = spans.withColumn("__cy", F.explode(F.expr(f"sequence(cast(y0 / {cell} AS int), greatest(cast(y0 / {cell} AS int), cast(y1 / {cell} AS int) - 1))")))
    mask = cells.withColumnsRenamed({"cx": "__cx", "cy": "__cy"})
    ratios = spans.join(mask, [*keys, "__cx", "__cy"]).groupBy(*tiles.columns).agg(F.avg(F.col("flag").cast("double")).alias("ratio"))
    masked = cells.select(*keys).distinct().withColumn("__masked", F.lit(True))
    named = tiles.join(ratios.select(*keys, "tile_idx", "ratio"), [*keys, "tile_idx"], "left").join(masked, keys, "left")
    return named.withColumn("keep", F.when(F.col("__masked").isNull(), True).otherwise(F.coalesce(F.col("ratio") >= least, F.lit(False)))).drop("__masked")


def is_background(pixels: Column, threshold: float = 15.0, std: Column | None = None) -> Column:
    """Whether the population standard deviation of grey values (std, where it is there already) is under threshold."""
    return (std_of(pixels) if std is None else std) < threshold


def keep_training(annotated: Column, tissue: Column, background: Column) -> Column:
    return annotated | (tissue & ~background)


def keep_inference(tissue: Column, background: Column) -> Column:
    return tissue & ~background


def raster_cells(boxes: DataFrame, cell: int) -> DataFrame:
    """boxes (x0..y1) for each lattice cell whose centre they hold: cx, cy."""
    span = lambda a, b: F.expr(f"sequence(cast(ceil({a} / {cell} - 0.5D) AS int), cast(ceil({b} / {cell} - 0.5D) AS int) - 1)")
    held = boxes.filter(F.expr(f"ceil(x1 / {cell} - 0.5D) > ceil(x0 / {cell} - 0.5D) AND ceil(y1 / {cell} - 0.5D) > ceil(y0 / {cell} - 0.5D)"))
    return held.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def compose_last(cells: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Later annotations overwrite earlier ones."""
    return cells.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def compose_max(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.max(value).alias(value))


def mosaic(tiles: DataFrame, keys: list[str], pixels: str, side: int, scale: int, order: str) -> DataFrame:
    """(keys, px, py, value): tiles (x0, y0, square pixels) pasted at origin // scale in order; later ones win."""
    each = tiles.select(*keys, order, F.floor(F.col("x0") / scale).alias("__ox"), F.floor(F.col("y0") / scale).alias("__oy"), F.posexplode(pixels).alias("__i", "__v"))
    at = each.withColumn("px", (F.col("__ox") + F.col("__i") % side).cast("int")).withColumn("py", (F.col("__oy") + F.floor(F.col("__i") / side)).cast("int"))
    return at.groupBy(*keys, "px", "py").agg(F.max_by("__v", order).alias("value"))


def canvas_extent(tiles: DataFrame, by: list[str], ratio: float = 1.0, vendor: bool = False) -> DataFrame:
    """Size and origin of a canvas that holds the tiles; vendor formats scale up by the ratio, others down."""
    scale = 1.0 / ratio if vendor else ratio
    side = lambda a, b: ((F.max(b) - F.min(a)) * F.lit(scale)).cast("int")
    return tiles.groupBy(*by).agg(side("x0", "x1").alias("width"), side("y0", "y1").alias("height"), F.min("x0").alias("min_x"), F.min("y0").alias("min_y"))


def capped_extent(extent: DataFrame, side: int = 8000) -> DataFrame:
    """canvas_extent() with the sides that capped() gives a canvas."""
    share = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest("width", "height"))
    return extent.withColumn("out_width", (F.col("width") * share).cast("int")).withColumn("out_height", (F.col("height") * share).cast("int"))


def pyramid(pixels: DataFrame, by: list[str], levels: int) -> DataFrame:
    """(by, level, px, py, value): each level halves the one below by the mean of 2 x 2 pixels (columns px, py, p)."""
    each = pixels.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    at = lambda c: F.expr(f"shiftright({c}, level)").alias(c)
    return each.groupBy(*by, "level", at("px"), at("py")).agg(F.avg("p").alias("value"))


def instances(labelled: DataFrame, by: list[str], least: int = 1500) -> DataFrame:
    """Area and inclusive bounds of each label (columns label, px, py), from least pixels up."""
    boxed = labelled.filter("label > 0").groupBy(*by, "label").agg(F.count("*").alias("area"), F.min("px").alias("x_min"), F.max("px").alias("x_max"), F.min("py").alias("y_min"), F.max("py").alias("y_max"))
    return boxed.filter(F.col("area") >= least)


# Kernels on dense images, one row each.


def map_images(df: DataFrame, fn: Callable[..., np.ndarray], columns: list[str], out: str) -> DataFrame:
    """df with binary column out: fn of the rows' columns (binary as uint8 arrays, numbers as they are)."""
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
            made = [None if any(v is None for v in row) else fn(*(np.frombuffer(v, np.uint8) if isinstance(v, bytes) else v for v in row)).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def color_transfer(rgb: np.ndarray, height: int, width: int, means: tuple = COLOR_MEANS, stds: tuple = COLOR_STDS) -> np.ndarray:
    """Channels moved to fixed means and deviations, measured on tissue (grey under 0.9) and applied everywhere.
    Under 100 tissue pixels the image stays as it is."""
    image = rgb.reshape(height, width, 3).astype(np.float64) / 255
    gray = np.floor(image @ np.array([0.299, 0.587, 0.114]) * 255) / 255
    tissue = gray < 0.9
    if tissue.sum() < 100:
        return rgb.reshape(height, width, 3)
    mean, std = image[tissue].mean(axis=0), np.maximum(image[tissue].std(axis=0), 1e-6)
    moved = (image - mean) / std * np.array(stds) + np.array(means)
    return (np.clip(moved, 0, 1) * 255).astype(np.uint8)


def resize_nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    ys, xs = ((np.arange(n) + 0.5) * m / n for n, m in ((height, a.shape[0]), (width, a.shape[1])))
    return a[ys.astype(int)[:, None], xs.astype(int)[None, :]]


def _weights(n: int, m: int, kernel: Callable[[np.ndarray], np.ndarray], reach: float) -> np.ndarray:
    """n x m matrix that resamples m samples to n; the kernel widens when shrinking."""
    scale = max(1.0, m / n)
    centre = (np.arange(n)[:, None] + 0.5) * m / n
    w = kernel((np.arange(m)[None, :] + 0.5 - centre) / scale)
    w[np.abs((np.arange(m)[None, :] + 0.5 - centre) / scale) >= reach] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int, method: str = "lanczos") -> np.ndarray:
    """uint8 image resampled by a separable kernel: lanczos (three lobes) or linear."""
    kernel, reach = (lambda x: np.sinc(x) * np.sinc(x / 3), 3.0) if method == "lanczos" else (lambda x: np.maximum(0, 1 - np.abs(x)), 1.0)
    flat = a.reshape(a.shape[0], a.shape[1], -1).astype(np.float64)
    out = np.einsum("ij,jkc->ikc", _weights(height, a.shape[0], kernel, reach), flat)
    out = np.einsum("ij,kjc->kic", _weights(width, a.shape[1], kernel, reach), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape((height, width) + a.shape[2:])


def crop_square(a: np.ndarray, side: int, cap: int = 2048) -> np.ndarray:
    """A crop resized to a square; a crop over cap first shrinks to it with its aspect kept."""
    h, w = a.shape[:2]
    if max(h, w) > cap:
        a = resize(a, max(1, int(cap * h / max(h, w))), max(1, int(cap * w / max(h, w))))
    return resize(a, side, side)


def saturation(rgb: np.ndarray) -> np.ndarray:
    """HSV saturation (0 to 255) of an RGB image."""
    top, low = rgb.max(axis=2).astype(np.float64), rgb.min(axis=2)
    return np.rint(np.divide((top - low) * 255, top, out=np.zeros_like(top), where=top > 0)).astype(np.uint8)


def median(a: np.ndarray, side: int = 7) -> np.ndarray:
    """Median of side x side windows, the edge repeated."""
    padded = np.pad(a, side // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (side, side)), axis=(2, 3)).astype(a.dtype)


def otsu_threshold(values: np.ndarray) -> int:
    """The threshold of otsu() for one array of bytes."""
    n = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, -1.0)
    return int(between.argmax())


def tissue_mask(rgb: np.ndarray, factor: int = 20) -> np.ndarray:
    """Mask (0 or 255) of a shrunken image: smoothed saturation over its Otsu threshold."""
    h, w = max(1, rgb.shape[0] // factor), max(1, rgb.shape[1] // factor)
    smooth = median(saturation(resize(rgb, h, w)))
    return np.where(smooth > otsu_threshold(smooth), 255, 0).astype(np.uint8)


def box_mask(height: int, width: int, y0: int, x0: int, y1: int, x1: int) -> np.ndarray:
    """Mask (0 or 255) of a filled box; ends are exclusive."""
    out = np.zeros((height, width), np.uint8)
    out[y0:y1, x0:x1] = 255
    return out


def on_white(rgba: np.ndarray) -> np.ndarray:
    """RGB of an RGBA image pasted on white through its alpha."""
    alpha = rgba[:, :, 3:].astype(np.int64)
    mixed = rgba[:, :, :3] * alpha + 255 * (255 - alpha) + 128
    return ((mixed + (mixed >> 8)) >> 8).astype(np.uint8)


def extract_tile(image: np.ndarray, x: int, y: int, size: int, fill: int = 255, paste: bool = False) -> np.ndarray:
    """A size x size x 3 tile from a grey, RGB or RGBA image; beyond the edge it is filled. Alpha is dropped, or with paste the
    image is pasted on white through it."""
    if paste and image.ndim == 3 and image.shape[2] == 4:
        image = on_white(image)
    rgb = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image[:, :, :3]
    out = np.full((size, size, 3), fill, np.uint8)
    part = rgb[max(0, y) : y + size, max(0, x) : x + size]
    out[max(0, -y) : max(0, -y) + part.shape[0], max(0, -x) : max(0, -x) + part.shape[1]] = part
    return out


def fill_polygon(xs: np.ndarray, ys: np.ndarray, size: int, outline: bool = False) -> np.ndarray:
    """Mask (bool) of a polygon by the even-odd rule at pixel centres, its vertices' pixels included; with outline the pixels under
    its edges too."""
    mask = np.zeros((size, size), bool)
    row = np.arange(size) + 0.5
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    for a, b, c, d in zip(xs, ys, x2, y2, strict=True):
        if b != d:
            hit = (row >= min(b, d)) & (row < max(b, d))
            at = a + (row - b) * (c - a) / (d - b)
            mask ^= hit[:, None] & (row[None, :] >= at[:, None])
    vx, vy = xs, ys
    if outline:
        steps = [np.linspace(0, 1, int(max(abs(c - a), abs(d - b))) + 1) for a, b, c, d in zip(xs, ys, x2, y2, strict=True)]
        vx = np.concatenate([np.rint(a + t * (c - a)) for a, c, t in zip(xs, x2, steps, strict=True)])
        vy = np.concatenate([np.rint(b + t * (d - b)) for b, d, t in zip(ys, y2, steps, strict=True)])
    vx, vy = vx.astype(int), vy.astype(int)
    ok = (vx >= 0) & (vx < size) & (vy >= 0) & (vy < size)
    mask[vy[ok], vx[ok]] = True
    return mask


def training_mask(xs: np.ndarray, ys: np.ndarray, box: tuple[int, int, int, int], size: int, zoom: float) -> np.ndarray:
    """Mask (bool) of a polygon in a tile: clipped to the tile's box, scaled, cut to whole pixels, filled with its outline."""
    for axis, bound, low in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        points = np.stack([xs, ys], axis=1).astype(float)
        after = np.roll(points, -1, axis=0)
        inside = points[:, axis] <= bound if low else points[:, axis] >= bound
        out = []
        for p, q, here, there in zip(points, after, inside, np.roll(inside, -1), strict=True):
            out += [p] if here else []
            if here != there:
                cut = p + (bound - p[axis]) / (q[axis] - p[axis]) * (q - p)
                cut[axis] = bound
                out.append(cut)
        if len(out) < 3:
            return np.zeros((size, size), bool)
        xs, ys = np.array(out).T
    return fill_polygon(np.trunc((xs - box[0]) * zoom), np.trunc((ys - box[1]) * zoom), size, outline=True)


def inference_mask(xs: np.ndarray, ys: np.ndarray, x: int, y: int, native: int, size: int) -> np.ndarray:
    """Mask (bool) of a polygon in an inference tile: each point moved into the native tile, filled there, then resized to size by
    nearest pixels."""
    cx, cy = (np.clip(np.asarray(v, float) - o, 0, native) for v, o in ((xs, x), (ys, y)))
    whole = fill_polygon(cx, cy, native, outline=True) if len(cx) >= 3 else np.zeros((native, native), bool)
    return whole if size == native else resize_nearest(whole, size, size)


def capped(a: np.ndarray, side: int = 8000) -> np.ndarray:
    """An image whose longer side is over side, shrunk to it with its aspect kept."""
    longest = max(a.shape[:2])
    if longest <= side:
        return a
    return resize(a, max(1, int(a.shape[0] * side / longest)), max(1, int(a.shape[1] * side / longest)))


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in reading order of their first pixel."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), h * w + 1)
    while True:
        low = label.copy()
        low[1:] = np.minimum(low[1:], label[:-1])
        low[:-1] = np.minimum(low[:-1], label[1:])
        low[:, 1:] = np.minimum(low[:, 1:], label[:, :-1])
        low[:, :-1] = np.minimum(low[:, :-1], label[:, 1:])
        low[~mask] = h * w + 1
        roots = np.concatenate([[0], low.ravel(), [h * w + 1]])
        low[mask] = np.minimum(low[mask], roots[low[mask]])  # jump to the label of the label's own pixel
        if (low == label).all():
            break
        label = low
    out = np.zeros((h, w), np.int32)
    found, inverse = np.unique(label[mask], return_inverse=True)
    out[mask] = inverse + 1 if len(found) else 0
    return out


def _shifted(mask: np.ndarray, grow: bool) -> np.ndarray:
    """Dilation (grow) or erosion by a 5 x 5 ellipse; outside counts as empty when growing, full when eroding."""
    offsets = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) < 2 or dx == 0]
    h, w = mask.shape
    padded = np.pad(mask, 2, constant_values=not grow)
    parts = [padded[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] for dy, dx in offsets]
    return np.any(parts, axis=0) if grow else np.all(parts, axis=0)


def _distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of set pixels to the nearest unset one: exact, one pass for each direction."""
    h, w = mask.shape
    far = float(h + w)
    column = np.where(mask, far, 0.0)
    for y in range(1, h):
        column[y] = np.minimum(column[y], column[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    xs = np.arange(w)
    gap = (xs[:, None] - xs[None, :]) ** 2
    return np.sqrt(np.stack([(row[None, :] ** 2 + gap).min(axis=1) for row in column]))


def separate(mask: np.ndarray, window: int = 15) -> np.ndarray:
    """Instances of a mask: closed twice and opened once, split at saddles of the distance to the edge.

    Markers are the maxima of the distance in windows; they flood the mask from far to near (a watershed).
    """
    clean = mask
    for grow in (True, True, False, False, False, True):
        clean = _shifted(clean, grow)
    dist = np.where(clean, _distance(clean), 0.0)
    r = window // 2
    padded = np.pad(dist, r)
    top = np.lib.stride_tricks.sliding_window_view(padded, (window, window)).max(axis=(2, 3))
    label = label_components(clean & (top == dist))
    import heapq

    heap = [(-dist[y, x], n, y, x) for n, (y, x) in enumerate(np.argwhere(label))]
    heapq.heapify(heap)
    n, (h, w) = len(heap), mask.shape
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for yy, xx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= yy < h and 0 <= xx < w and clean[yy, xx] and not label[yy, xx]:
                label[yy, xx] = label[y, x]
                n += 1
                heapq.heappush(heap, (-dist[yy, xx], n, yy, xx))
    return label
