"""Scalar expressions: class names, tile names, coordinate spaces, pixel codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASS_GRAYS, CLASS_IDS, CLASS_SPELLINGS, GRAY_COLORS, INFERENCE_GRAY_DEFAULT, INFERENCE_GRAYS, LARGE_FILE_BYTES


def literal_map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def class_name(raw: Column) -> Column:
    """Canonical class of a raw name; a name that no spelling matches stays as it is."""
    key = F.replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), F.lit(" "), F.lit(""))
    bare = {k.lower().replace("_", ""): k for k in CLASS_IDS}
    return F.coalesce(literal_map(bare | CLASS_SPELLINGS)[key], raw)


def class_id(name: Column) -> Column:
    """Id of a canonical class; any other is background, 0."""
    return F.coalesce(literal_map(CLASS_IDS)[name], F.lit(0))


def class_gray(name: Column) -> Column:
    return F.coalesce(literal_map(CLASS_GRAYS)[name], F.lit(0))


def inference_gray(raw: Column) -> Column:
    """Grey value in the inference tiler: by lower-cased spelling without trimming, 64 for any other."""
    return F.coalesce(literal_map(INFERENCE_GRAYS)[F.lower(raw)], F.lit(INFERENCE_GRAY_DEFAULT))


def class_bucket(raw: Column) -> Column:
    """Report bucket by substrings, in this order; null: counted in totals only."""
    c = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return (
        F.when(c.contains("no") & c.contains("prolif"), "No_Proliferativo")
        .when(c.contains("proliferativo"), "Proliferativo")
        .when(c.contains("esclerosado"), "Esclerosado")
        .when(c.contains("exclude"), "Excluyente")
    )


def gray_color(gray: Column) -> Column:
    """(r, g, b) of a mask's grey value; grey itself for values without a class."""
    colors = F.create_map(*[x for g, rgb in GRAY_COLORS.items() for x in (F.lit(g), F.array(*map(F.lit, rgb)))])
    return F.coalesce(colors[gray], F.array(gray, gray, gray))


def apply_lut(pixels: Column, lut: list[int]) -> Column:
    """Each pixel's entry of a 256-entry table."""
    entries = F.array(*map(F.lit, lut))
    return F.transform(pixels, lambda p: F.get(entries, p))


def class_gray_lut() -> list[int]:
    by_id = {CLASS_IDS[k]: v for k, v in CLASS_GRAYS.items()}
    return [by_id.get(i, 0) for i in range(256)]


def tile_name(stem: Column, x: Column, y: Column, endx: Column, endy: Column) -> Column:
    return F.format_string("%s_tile_x%05d_y%05d_endx%05d_endy%05d", stem, x, y, endx, endy)


def centered_name(stem: Column, gid: Column) -> Column:
    return F.format_string("%s_centered_g%04d", stem, gid)


TILE_NAME = r"^(.+)_tile_x(\d+)_y(\d+)_endx(\d+)_endy(\d+)"


def parse_tile_name(name: Column, pattern: str = TILE_NAME) -> Column:
    """(stem, x, y, endx, endy, width, height); null if the name is no tile's (centered tiles never are)."""
    part = lambda i: F.regexp_extract(name, pattern, i)
    number = lambda i: F.try_to_number(part(i), F.lit("9999999999")).cast("int")
    x, y, ex, ey = (number(i) for i in range(2, 6))
    row = F.struct(part(1).alias("stem"), x.alias("x"), y.alias("y"), ex.alias("endx"), ey.alias("endy"), (ex - x).alias("width"), (ey - y).alias("height"))
    return F.when(name.rlike(pattern), row)


def biopsy_of_tile(name: Column) -> Column:
    """What stands before the last "_tile_", the whole name without one."""
    got = F.regexp_extract(name, r"^(.*)_tile_", 1)
    return F.when(name.contains("_tile_"), got).otherwise(name)


def biopsy_of_path(path: Column) -> Column:
    """Biopsy of a path below the data folder: biopsy/images/..., else images' parent, else the parent, else the stem."""
    p = F.split(path, "/")
    n = F.size(p)
    stem = F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", "")
    return (
        F.when((n >= 3) & (F.get(p, F.lit(1)) == "images"), F.get(p, F.lit(0)))
        .when((n >= 3) & (F.get(p, n - 2) == "images") & (F.get(p, n - 3) != ""), F.get(p, n - 3))
        .when((n >= 2) & (F.get(p, n - 2) != ""), F.get(p, n - 2))
        .otherwise(stem)
    )


def crop_name(stem: Column, feature: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    cut = lambda c: c.cast("int")
    return F.format_string("%s_feat%04d_x%06d_y%06d_w%06d_h%06d", stem, feature, cut(x0), cut(y0), cut(x1 - x0), cut(y1 - y0))


def slide_format(path: Column, length: Column) -> Column:
    """Reader for a file: vendor formats and TIFFs over the size limit go to openslide, plain images to pil; else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("tif", "tiff"), F.when(length > LARGE_FILE_BYTES, "openslide").otherwise("pil")).when(ext.isin("svs", "ndpi", "vms"), "openslide").when(ext.isin("png", "jpg", "jpeg"), "pil")


def to_tile_length(native: Column, zoom: float, digits: int = 2) -> Column:
    return F.round(native * zoom, digits)


def to_tile_area(native: Column, zoom: float, digits: int = 2) -> Column:
    return F.round(native * (zoom * zoom), digits)


def tile_to_native(origin: Column, px: Column, pixel_scale: float = 1.0) -> Column:
    """Native coordinate of a tile pixel. 1.0 adds pixels as they are; the tile's zoom is the true scale."""
    return origin + px / F.lit(pixel_scale)


def expand_margin(x0: Column, y0: Column, x1: Column, y1: Column, ratio: float, limit: float = 100_000.0) -> Column:
    """Box grown by ratio times its larger side, kept within 0 and limit."""
    m = F.greatest(x1 - x0, y1 - y0) * ratio
    return F.struct(
        F.greatest(F.lit(0.0), x0 - m).alias("x0"),
        F.greatest(F.lit(0.0), y0 - m).alias("y0"),
        F.least(F.lit(limit), x1 + m).alias("x1"),
        F.least(F.lit(limit), y1 + m).alias("y1"),
    )


def pad_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: int = 10) -> Column:
    """Pixel box padded within the tile; the ends are exclusive."""
    return F.struct(
        F.greatest(F.lit(0), x0 - pad).alias("x0"),
        F.greatest(F.lit(0), y0 - pad).alias("y0"),
        F.least(width, x1 + pad).alias("x1"),
        F.least(height, y1 + pad).alias("y1"),
    )


def canvas_length(native: Column, zoom: float, scale: int, floor_first: bool = True) -> Column:
    """Tile side on a canvas: int(native / zoom) // scale, or int(native / zoom / scale), one at least."""
    at = native / F.lit(zoom)
    got = F.floor(at.cast("bigint") / scale) if floor_first else (at / scale).cast("bigint")
    return F.greatest(F.lit(1), got.cast("int"))


def memory_gb(length: Column, factor: float = 5.0) -> Column:
    return length / float(1 << 30) * factor


def recommended_tile(size: Column, step: int = 128, largest: int = 2560) -> Column:
    """The first multiple of step that holds size, largest at most."""
    return F.least(F.lit(largest), F.greatest(F.lit(step), (F.ceil(size / step) * step).cast("int")))


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def std_of(xs: Column) -> Column:
    """Population standard deviation of an array of numbers; null if it is empty.

    Running means in the array's order, by the steps of DuckDB's stddev_pop, so that a deviation that lies on a threshold but for
    rounding falls on the same side as in SQL.
    """

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1.0
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["sq"] + (x - mean) * (x - a["mean"])).alias("sq"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "sq")])
    return F.aggregate(xs, start, step, lambda a: F.when(a["n"] > 0, F.sqrt(a["sq"] / a["n"])))


def zscore(xs: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (std + eps) over the whole array."""
    stats = F.array(F.struct(mean_of(xs).alias("m"), std_of(xs).alias("s")))
    return F.get(F.transform(stats, lambda q: F.transform(xs, lambda x: (x - q["m"]) / (q["s"] + eps))), F.lit(0))


def zscore_to_byte(z: Column) -> Column:
    return F.transform(z, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), ((v + 4) / 8 * 255).cast("int"))))


def byte_to_zscore(u: Column) -> Column:
    return F.transform(u, lambda v: v / 255.0 * 8 - 4)


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def softmax(logits: Column) -> Column:
    return F.get(
        F.transform(
            F.array(F.transform(logits, lambda x: F.exp(x.cast("double")))),
            lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)),
        ),
        F.lit(0),
    )


def argmax(xs: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def overlay(src: Column, dst: Column, mask: Column, alpha: int = 180) -> Column:
    """Blend of an overlay sample over an image sample where the mask is set."""
    return F.when(mask > 0, F.round((src * alpha + dst * (255 - alpha)) / 255).cast("int")).otherwise(dst)
