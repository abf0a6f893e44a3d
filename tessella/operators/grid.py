"""Tile grids, tiles around objects, and the spatial joins between objects and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_overlap

#: Tiles up to which a join broadcasts them (a row is some 60 bytes).
BROADCAST_TILES = 200_000


def _steps(length: str, tile: int, stride: int) -> str:
    return f"CASE WHEN {length} >= {tile} THEN sequence(0, {length} - {tile}, {stride}) ELSE cast(array() AS array<int>) END"


def training_grid(slides: DataFrame, tile: int, stride: int) -> DataFrame:
    """slides (width, height int) with tile_idx and x0..y1: whole tiles row by row, then a right column, a bottom row
    and a corner where the lattice stops short of the edge. A slide smaller than a tile has none. No shuffle: the index
    follows from the position."""
    plain = slides.withColumn("__xs", F.expr(_steps("width", tile, stride))).withColumn("__ys", F.expr(_steps("height", tile, stride)))
    edged = plain.withColumn("__x", F.expr(f"CASE WHEN size(__xs) > 0 AND element_at(__xs, -1) < width - {tile} THEN array(width - {tile}) ELSE cast(array() AS array<int>) END"))
    edged = edged.withColumn("__y", F.expr(f"CASE WHEN size(__ys) > 0 AND element_at(__ys, -1) < height - {tile} THEN array(height - {tile}) ELSE cast(array() AS array<int>) END"))
    cross = lambda xs, ys: f"flatten(transform({ys}, y -> transform({xs}, x -> struct(x AS x0, y AS y0))))"
    boxes = f"CASE WHEN size(__xs) = 0 OR size(__ys) = 0 THEN {cross('__x', '__y')} ELSE concat({cross('__xs', '__ys')}, {cross('__x', '__ys')}, {cross('__xs', '__y')}, {cross('__x', '__y')}) END"
    out = edged.filter("size(__xs) > 0 AND size(__ys) > 0").select(*slides.columns, F.posexplode(F.expr(boxes)).alias("tile_idx", "__b"))
    return out.select(*slides.columns, "tile_idx", "__b.x0", "__b.y0", (F.col("__b.x0") + tile).alias("x1"), (F.col("__b.y0") + tile).alias("y1"))


def inference_grid(slides: DataFrame, tile: int, stride: int) -> DataFrame:
    """slides with tile_idx and x0..y1 for every stride in both directions, edge tiles clipped to the slide."""
    boxes = f"flatten(transform(sequence(0, height - 1, {stride}), y -> transform(sequence(0, width - 1, {stride}), x -> struct(x AS x0, y AS y0))))"
    out = slides.filter("width > 0 AND height > 0").select("*", F.posexplode(F.expr(boxes)).alias("tile_idx", "__b"))
    x1, y1 = F.least(F.col("__b.x0") + tile, F.col("width")), F.least(F.col("__b.y0") + tile, F.col("height"))
    return out.select(*slides.columns, "tile_idx", "__b.x0", "__b.y0", x1.alias("x1"), y1.alias("y1"))


def centered_box(cx: Column, cy: Column, tile: int, width: Column, height: Column) -> Column:
    """Tile around a point: truncated, then moved into the slide."""
    low = lambda c, side: F.greatest(F.lit(0), F.least((c - tile // 2).cast("int"), side - tile))
    return F.struct(low(cx, width).alias("x0"), low(cy, height).alias("y0"), (low(cx, width) + tile).alias("x1"), (low(cy, height) + tile).alias("y1"))


def box_join(objects: DataFrame, tiles: DataFrame, cell: int, inclusive: bool, keys: tuple[str, ...] = (), small_tiles: int | None = None) -> DataFrame:
    """Pairs of objects (x0..y1) and tiles (x0..y1, here tx0..ty1) whose boxes overlap; inclusive: touching counts.

    Both sides are posted under the lattice cells they reach, so the join is on equal cells (and keys). A pair that
    shares several cells is kept in the one that holds the lower corner of its common part: no DISTINCT. The tiles are
    broadcast only if small_tiles (their number, known from the grid) is within BROADCAST_TILES.
    """
    corner = [c for c in ("x0", "y0", "x1", "y1") if c in tiles.columns]
    tiles = tiles.withColumnsRenamed({c: f"t{c}" for c in corner})
    at = lambda c: F.floor(F.col(c) / cell).cast("int")

    def posted(df: DataFrame, p: str) -> DataFrame:
        low, high = (f"{p}x0", f"{p}y0"), (f"{p}x1", f"{p}y1")
        xs = F.explode(F.sequence(at(low[0]), at(high[0])))
        return df.withColumn("__cx", xs).withColumn("__cy", F.explode(F.sequence(at(low[1]), at(high[1]))))

    right = posted(tiles, "t")
    if small_tiles is not None and small_tiles <= BROADCAST_TILES:
        right = F.broadcast(right)
    pairs = posted(objects, "").join(right, [*keys, "__cx", "__cy"])
    first = lambda a, b: F.floor(F.greatest(F.col(a), F.col(b)) / cell).cast("int")
    pairs = pairs.filter((first("x0", "tx0") == F.col("__cx")) & (first("y0", "ty0") == F.col("__cy")))
    x0, y0, x1, y1, a, b, c, d = (F.col(k) for k in ("x0", "y0", "x1", "y1", "tx0", "ty0", "tx1", "ty1"))
    meet = (x0 <= c) & (x1 >= a) & (y0 <= d) & (y1 >= b) if inclusive else (x0 < c) & (x1 > a) & (y0 < d) & (y1 > b)
    return pairs.filter(meet).drop("__cx", "__cy")


def homes(objects: DataFrame, tiles: DataFrame, cell: int, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """objects (x0..y1) and tiles (tx0..ty1, sides of at most cell) under the lattice cells __cx, __cy where they meet, and the numbers
    of both (n_objects, n_tiles) in each cell with any tile.

    A tile stands in the lattice cell of its lower corner alone, and objects are listed once in each cell from which a tile reaches
    them. So no row of a pair is ever made, shuffled or gathered: a tile's objects are filtered out of its cell's list.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    own = [*keys, "__cx", "__cy"]
    posted = objects.withColumn("__cx", F.explode(F.sequence(at("x0") - 1, at("x1")))).withColumn("__cy", F.explode(F.sequence(at("y0") - 1, at("y1"))))
    placed = tiles.withColumn("__cx", at("tx0")).withColumn("__cy", at("ty0"))
    counts = placed.groupBy(*own).agg(F.count("*").alias("n_tiles")).join(posted.groupBy(*own).agg(F.count("*").alias("n_objects")), own, "left").na.fill(0, ["n_objects"])
    return posted, placed, counts


def box_coverage() -> Column:
    """Percent of the object's box (x0..y1) inside the tile (tx0..ty1)."""
    a = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    shared = box_overlap(*(F.col(k) for k in ("x0", "y0", "x1", "y1", "tx0", "ty0", "tx1", "ty1")))
    return F.when(a > 0, shared / a * 100).otherwise(0.0)
