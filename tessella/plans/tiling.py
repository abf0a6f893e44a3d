"""Queries on grids, spatial joins, assignment and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bridge import ANN_SQL, SLIDE, SLIDES, TILE, annotations, polygons, slides, table
from ..functions import geometry as g
from ..functions import scalars as s
from ..operators import assign, grid

#: Tiles of all slides: the lattice and its edges are known before any data is read.
N_TILES = SLIDES * (-(-SLIDE // TILE)) ** 2
CENTERED = 1024


def _objects(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """annotations(), of the few slides of only if it is given."""
    a = annotations(spark, sf_dir)
    return a if only is None else a.join(F.broadcast(only.select("slide")), "slide", "left_semi")


def _pairs(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Objects with each training tile they overlap and the share of their box inside it."""
    tiles = grid.training_grid(slides(spark), TILE, TILE).drop("width", "height")
    pairs = grid.box_join(_objects(spark, sf_dir, only), tiles, TILE, inclusive=False, keys=("slide",), small_tiles=N_TILES)
    return pairs.withColumn("coverage", grid.box_coverage()).filter("coverage > 0")


def _assigned(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    pairs = _pairs(spark, sf_dir, only).withColumn("class_name", s.class_name(F.col("raw_class")))
    return assign.ranked_assignment(pairs, ["slide", "gid"], ["class_name", "x0", "y0", "x1", "y1"])


GRID_SQL = f"""ax AS (SELECT range AS i, range * {TILE} AS v FROM range(0, {(SLIDE - TILE) // TILE + 1})),
tiles AS (
  SELECT CAST(row_number() OVER (ORDER BY pr, y, x) - 1 AS INTEGER) AS tile_idx, x AS tx0, y AS ty0, x + {TILE} AS tx1, y + {TILE} AS ty1 FROM (
    SELECT 0 AS pr, a.v AS x, b.v AS y FROM ax a, ax b
    UNION ALL SELECT 1, {SLIDE - TILE}, b.v FROM ax b
    UNION ALL SELECT 2, a.v, {SLIDE - TILE} FROM ax a
    UNION ALL SELECT 3, {SLIDE - TILE}, {SLIDE - TILE}))"""

CLASS_SQL = """CASE replace(lower(trim(raw_class)), ' ', '') WHEN 'noprolif' THEN 'No_Proliferativo' WHEN 'noproliferativo' THEN 'No_Proliferativo'
  WHEN 'no_proliferativo' THEN 'No_Proliferativo' WHEN 'proliferativo' THEN 'Proliferativo' WHEN 'prolif' THEN 'Proliferativo'
  WHEN 'esclerosado' THEN 'Esclerosado' WHEN 'sclerosed' THEN 'Esclerosado' WHEN 'sclerotic' THEN 'Esclerosado'
  WHEN 'exclude' THEN 'Excluido' WHEN 'excluido' THEN 'Excluido' WHEN 'excluyente' THEN 'Excluido' WHEN 'excluded' THEN 'Excluido'
  WHEN 'background' THEN 'background' ELSE raw_class END"""

PAIRS_SQL = f"""ann AS ({ANN_SQL}), {GRID_SQL},
pairs AS (SELECT a.*, {CLASS_SQL} AS class_name, t.*,
    (least(x1, tx1) - greatest(x0, tx0)) * (least(y1, ty1) - greatest(y0, ty0)) / ((x1 - x0) * (y1 - y0)) * 100 AS coverage
  FROM ann a JOIN tiles t ON a.x0 < t.tx1 AND a.x1 > t.tx0 AND a.y0 < t.ty1 AND a.y1 > t.ty0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY slide, gid ORDER BY coverage DESC, tile_idx) AS rk FROM pairs),
assigned AS (SELECT slide, gid, class_name, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1,
    max(CASE WHEN rk = 1 THEN coverage END) < 60 AS primary_is_centered,
    CASE WHEN max(CASE WHEN rk = 1 THEN coverage END) >= 60 THEN max(CASE WHEN rk = 1 THEN tile_idx END) END AS primary_tile,
    CASE WHEN max(CASE WHEN rk = 1 THEN coverage END) >= 60 THEN max(CASE WHEN rk = 1 THEN coverage END) ELSE 0 END AS primary_coverage,
    CASE WHEN max(CASE WHEN rk = 1 THEN coverage END) >= 60 THEN max(CASE WHEN rk = 2 THEN tile_idx END) ELSE max(CASE WHEN rk = 1 THEN tile_idx END) END AS secondary_tile,
    CASE WHEN max(CASE WHEN rk = 1 THEN coverage END) >= 60 THEN coalesce(max(CASE WHEN rk = 2 THEN coverage END), 0) ELSE max(CASE WHEN rk = 1 THEN coverage END) END AS secondary_coverage
  FROM ranked GROUP BY slide, gid, class_name)"""


def tile_assignment(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return a.groupBy("slide", "class_name").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("primary_is_centered")).alias("n_primary_grid"),
        F.count_if("primary_is_centered").alias("n_centered"),
        F.count("secondary_tile").alias("n_secondary"),
        F.round(F.sum("primary_coverage"), 4).alias("primary_coverage"),
    )


TILE_ASSIGNMENT = f"""WITH {PAIRS_SQL} SELECT slide, class_name, count(*) AS n, count_if(NOT primary_is_centered)::BIGINT AS n_primary_grid,
  count_if(primary_is_centered)::BIGINT AS n_centered, count(secondary_tile) AS n_secondary, round(sum(primary_coverage), 4) AS primary_coverage
FROM assigned GROUP BY slide, class_name"""


def tile_registry_roles(spark, sf_dir):
    """Objects of each tile by role, their coverage, and a digest of them that is a sum, so that partial aggregates merge.

    The primary tile is the pair of largest coverage, so one shuffle by object gives roles without a second join.
    """
    pairs = _pairs(spark, sf_dir)
    best = pairs.groupBy("slide", "gid").agg(F.array_sort(F.collect_list(F.struct((-F.col("coverage")).alias("c"), F.col("tile_idx").alias("i")))).alias("o"))
    own = F.when(F.get("o", F.lit(0))["c"] <= -assign.MIN_COVERAGE, F.get("o", F.lit(0))["i"])
    each = best.withColumn("own", own).select("slide", "gid", "own", F.explode("o").alias("p"))
    role = F.when(F.col("p.i") == F.col("own"), "primary").otherwise("secondary")
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.format_string("%010d", "gid"), role)), 1, 15), 16, 10).cast("decimal(38,0)")
    return each.groupBy("slide", F.col("p.i").alias("tile_idx")).agg(
        F.count("*").alias("n_objects"), F.count_if(role == "primary").alias("n_primary"), F.round(F.sum(-F.col("p.c")), 4).alias("coverage"), F.sum(digest).cast("string").alias("objects_digest")
    )


TILE_REGISTRY_ROLES = f"""WITH {PAIRS_SQL},
roles AS (SELECT r.slide, r.tile_idx, r.gid, r.coverage, CASE WHEN r.tile_idx = a.primary_tile THEN 'primary' ELSE 'secondary' END AS role
  FROM ranked r JOIN assigned a ON a.slide = r.slide AND a.gid = r.gid)
SELECT slide, tile_idx, count(*) AS n_objects, count_if(role = 'primary')::BIGINT AS n_primary, round(sum(coverage), 4) AS coverage,
  CAST(sum(CAST('0x' || substr(md5(printf('%010d', gid) || ':' || role), 1, 15) AS HUGEINT)) AS VARCHAR) AS objects_digest FROM roles GROUP BY slide, tile_idx"""

INFERENCE_STRIDE, INFERENCE_TILE = 1536, 2048


def _inference_pairs(spark, sf_dir):
    tiles = grid.inference_grid(slides(spark), INFERENCE_TILE, INFERENCE_STRIDE).drop("width", "height")
    n = SLIDES * (-(-SLIDE // INFERENCE_STRIDE)) ** 2
    return grid.box_join(annotations(spark, sf_dir), tiles, INFERENCE_STRIDE, inclusive=True, keys=("slide",), small_tiles=n)


INFERENCE_SQL = f"""ann AS ({ANN_SQL}), ax AS (SELECT range AS i, range * {INFERENCE_STRIDE} AS v FROM range(0, {-(-SLIDE // INFERENCE_STRIDE)})),
tiles AS (SELECT CAST(b.i * {-(-SLIDE // INFERENCE_STRIDE)} + a.i AS INTEGER) AS tile_idx, a.v AS tx0, b.v AS ty0,
  least(a.v + {INFERENCE_TILE}, {SLIDE}) AS tx1, least(b.v + {INFERENCE_TILE}, {SLIDE}) AS ty1 FROM ax a, ax b),
pairs AS (SELECT a.*, t.* FROM ann a JOIN tiles t ON a.x0 <= t.tx1 AND a.x1 >= t.tx0 AND a.y0 <= t.ty1 AND a.y1 >= t.ty0)"""


def tile_annotation_bbox(spark, sf_dir):
    p = _inference_pairs(spark, sf_dir)
    return p.groupBy("slide", "tile_idx").agg(F.count("*").alias("n"), F.min("gid").alias("min_gid"), F.max("gid").alias("max_gid"), F.max(s.inference_gray(F.col("raw_class"))).alias("max_gray"))


INFERENCE_GRAY_SQL = """CASE lower(raw_class) WHEN 'no prolif' THEN 64 WHEN 'no_proliferativo' THEN 64 WHEN 'prolif' THEN 128 WHEN 'proliferativo' THEN 128
  WHEN 'esclerosado' THEN 192 WHEN 'exclude' THEN 255 WHEN 'excluido' THEN 255 WHEN 'excluded' THEN 255 ELSE 64 END"""
TILE_ANNOTATION_BBOX = f"WITH {INFERENCE_SQL} SELECT slide, tile_idx, count(*) AS n, min(gid) AS min_gid, max(gid) AS max_gid, max({INFERENCE_GRAY_SQL}) AS max_gray FROM pairs GROUP BY slide, tile_idx"


def glom_tile_index(spark, sf_dir):
    """Every object with the tiles it touches; an object outside all tiles keeps an empty list."""
    tiles = assign.inverted(_inference_pairs(spark, sf_dir), ["slide", "gid"], F.col("tile_idx"), "tiles")
    ann = annotations(spark, sf_dir).select("slide", "gid", "raw_class")
    listed = ann.join(tiles, ["slide", "gid"], "left").withColumn("tiles", F.coalesce("tiles", F.array().cast("array<int>")))
    return listed.select("slide", "gid", F.size("tiles").alias("n_tiles"), F.array_join("tiles", ",").alias("tiles"))


GLOM_TILE_INDEX = f"""WITH {INFERENCE_SQL} SELECT a.slide, a.gid, CAST(count(p.tile_idx) AS INTEGER) AS n_tiles, coalesce(string_agg(CAST(p.tile_idx AS VARCHAR), ',' ORDER BY p.tile_idx), '') AS tiles
FROM ann a LEFT JOIN pairs p ON p.slide = a.slide AND p.gid = a.gid GROUP BY a.slide, a.gid"""


def _sheets(spark, sf_dir) -> DataFrame:
    """One image for each supplier, some smaller than a tile: slide, width, height."""
    side = lambda least, parts, step: (F.lit(least) + F.col("s_suppkey") % parts * step).cast("int")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slide"), side(1500, 23, 517).alias("width"), side(1700, 17, 431).alias("height"))


SHEETS_SQL = "sheets AS (SELECT s_suppkey AS slide, CAST(1500 + s_suppkey % 23 * 517 AS INTEGER) AS w, CAST(1700 + s_suppkey % 17 * 431 AS INTEGER) AS h FROM supplier)"


def grid_training(spark, sf_dir):
    return grid.training_grid(_sheets(spark, sf_dir), TILE, TILE).select("slide", "tile_idx", "x0", "y0", "x1", "y1")


GRID_TRAINING = f"""WITH {SHEETS_SQL}, fit AS (SELECT * FROM sheets WHERE w >= {TILE} AND h >= {TILE}),
xs AS (SELECT slide, CAST(unnest(range(0, w - {TILE} + 1, {TILE})) AS INTEGER) AS x, 0 AS e FROM fit UNION ALL SELECT slide, w - {TILE}, 1 FROM fit WHERE w % {TILE} <> 0),
ys AS (SELECT slide, CAST(unnest(range(0, h - {TILE} + 1, {TILE})) AS INTEGER) AS y, 0 AS e FROM fit UNION ALL SELECT slide, h - {TILE}, 1 FROM fit WHERE h % {TILE} <> 0)
SELECT xs.slide, CAST(row_number() OVER (PARTITION BY xs.slide ORDER BY xs.e + 2 * ys.e, y, x) - 1 AS INTEGER) AS tile_idx, x AS x0, y AS y0, x + {TILE} AS x1, y + {TILE} AS y1 FROM xs JOIN ys ON ys.slide = xs.slide"""


def grid_inference(spark, sf_dir):
    t = grid.inference_grid(_sheets(spark, sf_dir), INFERENCE_TILE, INFERENCE_STRIDE)
    return t.select("slide", "tile_idx", s.tile_name(F.concat(F.lit("s"), "slide"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("name"))


GRID_INFERENCE = f"""WITH {SHEETS_SQL}, xs AS (SELECT slide, w, h, CAST(unnest(range(0, w, {INFERENCE_STRIDE})) AS INTEGER) AS x FROM sheets),
xy AS (SELECT slide, w, h, x, CAST(unnest(range(0, h, {INFERENCE_STRIDE})) AS INTEGER) AS y FROM xs)
SELECT slide, CAST(row_number() OVER (PARTITION BY slide ORDER BY y, x) - 1 AS INTEGER) AS tile_idx,
  's' || slide || printf('_tile_x%05d_y%05d_endx%05d_endy%05d', x, y, least(x + {INFERENCE_TILE}, w), least(y + {INFERENCE_TILE}, h)) AS name FROM xy"""


def tile_name_roundtrip(spark, sf_dir):
    a = annotations(spark, sf_dir)
    cut = lambda c: F.col(c).cast("int")
    named = a.select("gid", s.tile_name(F.concat(F.lit("slide_"), F.col("slide")), cut("x0"), cut("y0"), cut("x1"), cut("y1")).alias("name"))
    t = named.withColumn("t", s.parse_tile_name(F.col("name")))
    return t.select("gid", "name", "t.stem", "t.x", "t.y", "t.endx", "t.endy", "t.width", "t.height", s.biopsy_of_tile(F.col("name")).alias("biopsy"))


TILE_NAME_ROUNDTRIP = f"""WITH ann AS ({ANN_SQL}), i AS (SELECT gid, 'slide_' || slide AS stem, x0::INTEGER AS x, y0::INTEGER AS y, x1::INTEGER AS endx, y1::INTEGER AS endy FROM ann)
SELECT gid, stem || printf('_tile_x%05d_y%05d_endx%05d_endy%05d', x, y, endx, endy) AS name, stem, x, y, endx, endy, endx - x AS width, endy - y AS height, stem AS biopsy FROM i"""


def centered_tiles(spark, sf_dir):
    """Objects without a grid tile of enough coverage, with the tile centred on them and its true coverage."""
    a = _assigned(spark, sf_dir).filter("primary_is_centered")
    box = grid.centered_box((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, CENTERED, F.lit(SLIDE), F.lit(SLIDE))
    t = a.withColumn("t", box)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cov = g.box_overlap(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), *(F.col(f"t.{c}") for c in ("x0", "y0", "x1", "y1"))) / area * 100
    return t.select("slide", "gid", F.col("t.x0").alias("tx0"), F.col("t.y0").alias("ty0"), F.round(cov, 6).alias("coverage"), s.centered_name(F.concat(F.lit("slide_"), F.col("slide")), F.col("gid")).alias("name"))


CENTERED_TILES = f"""WITH {PAIRS_SQL}, c AS (SELECT *, CAST(greatest(0, least(trunc((x0 + x1) / 2 - {CENTERED // 2}), {SLIDE - CENTERED})) AS INTEGER) AS tx0,
  CAST(greatest(0, least(trunc((y0 + y1) / 2 - {CENTERED // 2}), {SLIDE - CENTERED})) AS INTEGER) AS ty0 FROM assigned WHERE primary_is_centered)
SELECT slide, gid, tx0, ty0, round(greatest(0, least(x1, tx0 + {CENTERED}) - greatest(x0, tx0)) * greatest(0, least(y1, ty0 + {CENTERED}) - greatest(y0, ty0)) / ((x1 - x0) * (y1 - y0)) * 100, 6) AS coverage,
  printf('slide_%d_centered_g%04d', slide, gid) AS name FROM c"""


def dataset_summary(spark, sf_dir):
    """Tiles of each slide that hold objects, those that are some object's primary, and objects by class."""
    a = _assigned(spark, sf_dir)
    return a.groupBy("slide").agg(
        F.count("*").alias("n_objects"),
        F.count_distinct("primary_tile").alias("n_primary_tiles"),
        F.count_if("primary_is_centered").alias("n_centered_tiles"),
        *[F.count_if(F.col("class_name") == c).alias(f"n_{c.lower()}") for c in ("No_Proliferativo", "Proliferativo", "Esclerosado", "Excluido")],
    )


DATASET_SUMMARY = f"""WITH {PAIRS_SQL} SELECT slide, count(*) AS n_objects, count(DISTINCT primary_tile) AS n_primary_tiles, count_if(primary_is_centered)::BIGINT AS n_centered_tiles,
  count_if(class_name = 'No_Proliferativo')::BIGINT AS n_no_proliferativo, count_if(class_name = 'Proliferativo')::BIGINT AS n_proliferativo,
  count_if(class_name = 'Esclerosado')::BIGINT AS n_esclerosado, count_if(class_name = 'Excluido')::BIGINT AS n_excluido FROM assigned GROUP BY slide"""


def coverage_index(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return a.select("slide", "gid", "class_name", "primary_tile", "secondary_tile", F.round("primary_coverage", 6).alias("primary_coverage"), F.round("secondary_coverage", 6).alias("secondary_coverage"))


COVERAGE_INDEX = f"WITH {PAIRS_SQL} SELECT slide, gid, class_name, primary_tile, secondary_tile, round(primary_coverage, 6) AS primary_coverage, round(secondary_coverage, 6) AS secondary_coverage FROM assigned"


def polygon_metrics(spark, sf_dir):
    p = polygons(spark, sf_dir)
    r = F.col("ring")
    six = lambda c, n: F.round(c, 6).alias(n)
    measured = p.select("gid", g.area(r).alias("a"), g.perimeter(r).alias("p"), g.bounds(r).alias("b"), g.centroid(r).alias("c"))
    return measured.select(
        "gid", six(F.col("a"), "area"), six(F.col("p"), "perimeter"), six(g.circularity(F.col("a"), F.col("p")), "circularity"),
        six(F.col("b.x1") - F.col("b.x0"), "width"), six(F.col("b.y1") - F.col("b.y0"), "height"), six(F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")), "square_size"),
        six(F.col("c.x"), "cx"), six(F.col("c.y"), "cy"),
    )


POLYGON_METRICS = f"""WITH ann AS ({ANN_SQL}), v AS (SELECT gid, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h FROM ann),
e AS (SELECT gid, w, h, unnest([[x0, y0, x1, y0], [x1, y0, x1, y1], [x1, y1, (x0 + x1) / 2, (y0 + y1) / 2], [(x0 + x1) / 2, (y0 + y1) / 2, x0, y1], [x0, y1, x0, y0]]) AS e FROM v),
k AS (SELECT gid, w, h, e[1] * e[4] - e[3] * e[2] AS c, e[1] + e[3] AS sx, e[2] + e[4] AS sy, sqrt((e[3] - e[1]) * (e[3] - e[1]) + (e[4] - e[2]) * (e[4] - e[2])) AS l FROM e),
m AS (SELECT gid, any_value(w) AS w, any_value(h) AS h, sum(c) / 2 AS a, sum(l) AS p, sum(sx * c) / (3 * sum(c)) AS cx, sum(sy * c) / (3 * sum(c)) AS cy FROM k GROUP BY gid)
SELECT gid, round(abs(a), 6) AS area, round(p, 6) AS perimeter, round(4 * pi() * abs(a) / (p * p), 6) AS circularity, round(w, 6) AS width, round(h, 6) AS height,
  round(greatest(w, h), 6) AS square_size, round(cx, 6) AS cx, round(cy, 6) AS cy FROM m"""


def polygon_coverage(spark, sf_dir):
    """Concave polygons against training tiles: boxes are joined first, then the exact share is clipped."""
    tiles = grid.training_grid(slides(spark), TILE, TILE).drop("width", "height")
    pairs = grid.box_join(polygons(spark, sf_dir), tiles, TILE, inclusive=False, keys=("slide",), small_tiles=N_TILES)
    shares = g.with_coverage(pairs, "ring", ("tx0", "ty0", "tx1", "ty1"), ["slide", "gid", "tile_idx"])
    return shares.withColumn("coverage", F.round("coverage", 4)).filter("coverage > 0")


def _clip_sql(source: str, name: str, axis: int, bound: str, sign: str) -> str:
    """CTE: each ring (list of [x, y]) clipped to one side of a line."""
    other = 3 - axis
    inside = lambda p: f"{p}[{axis}] {sign} {bound}"
    t = f"({bound} - e[1][{axis}]) / (e[2][{axis}] - e[1][{axis}])"
    along, across = f"CAST({bound} AS DOUBLE)", f"e[1][{other}] + {t} * (e[2][{other}] - e[1][{other}])"
    point = f"[{along}, {across}]" if axis == 1 else f"[{across}, {along}]"
    body = f"CASE WHEN {inside('e[1]')} AND {inside('e[2]')} THEN [e[1]] WHEN {inside('e[1]')} THEN [e[1], {point}] WHEN {inside('e[2]')} THEN [{point}] ELSE [] END"
    return f"""{name} AS (SELECT * REPLACE (flatten(list_transform(list_zip(ring, list_concat(ring[2:], ring[1:1])), lambda e: {body})) AS ring) FROM {source})"""


POLYGON_COVERAGE = f"""WITH ann AS ({ANN_SQL}), {GRID_SQL},
p0 AS (SELECT a.slide, a.gid, t.tile_idx, tx0, ty0, tx1, ty1, (x1 - x0) * (y1 - y0) * 0.75e0 AS whole, [[x0, y0], [x1, y0], [x1, y1], [(x0 + x1) / 2, (y0 + y1) / 2], [x0, y1]] AS ring
  FROM ann a JOIN tiles t ON a.x0 < t.tx1 AND a.x1 > t.tx0 AND a.y0 < t.ty1 AND a.y1 > t.ty0),
{_clip_sql("p0", "p1", 1, "tx0", ">=")}, {_clip_sql("p1", "p2", 1, "tx1", "<=")}, {_clip_sql("p2", "p3", 2, "ty0", ">=")}, {_clip_sql("p3", "p4", 2, "ty1", "<=")},
a AS (SELECT slide, gid, tile_idx, whole, abs(list_sum(list_transform(list_zip(ring, list_concat(ring[2:], ring[1:1])), lambda e: e[1][1] * e[2][2] - e[2][1] * e[1][2]))) / 2 AS part FROM p4 WHERE len(ring) > 0)
SELECT * FROM (SELECT slide, gid, tile_idx, round(part / whole * 100, 4) AS coverage FROM a) WHERE coverage > 0"""


def crop_margin_manifest(spark, sf_dir):
    a = annotations(spark, sf_dir)
    box = s.expand_margin(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), 0.25)
    m = a.withColumn("m", box)
    six = lambda c: F.round(F.col(f"m.{c}"), 6).alias(f"m{c}")
    name = s.crop_name(F.concat(F.lit("slide_"), F.col("slide")), F.col("gid"), F.col("m.x0"), F.col("m.y0"), F.col("m.x1"), F.col("m.y1"))
    return m.select("gid", six("x0"), six("y0"), six("x1"), six("y1"), name.alias("tile_file"))


CROP_MARGIN_MANIFEST = f"""WITH ann AS ({ANN_SQL}), m AS (SELECT gid, slide, x0, y0, x1, y1, greatest(x1 - x0, y1 - y0) * 0.25e0 AS k FROM ann),
b AS (SELECT gid, slide, greatest(0e0, x0 - k) AS a, greatest(0e0, y0 - k) AS b, least(100000e0, x1 + k) AS c, least(100000e0, y1 + k) AS d FROM m)
SELECT gid, round(a, 6) AS mx0, round(b, 6) AS my0, round(c, 6) AS mx1, round(d, 6) AS my1,
  printf('slide_%d_feat%04d_x%06d_y%06d_w%06d_h%06d', slide, gid, trunc(a)::INTEGER, trunc(b)::INTEGER, trunc(c - a)::INTEGER, trunc(d - b)::INTEGER) AS tile_file FROM b"""


def class_normalize(spark, sf_dir):
    a = annotations(spark, sf_dir).withColumn("class_name", s.class_name(F.col("raw_class")))
    return a.groupBy("raw_class", "class_name").agg(F.count("*").alias("n")).withColumn("class_id", s.class_id(F.col("class_name"))).withColumn("gray", s.class_gray(F.col("class_name")))


CLASS_NORMALIZE = f"""WITH ann AS ({ANN_SQL}), c AS (SELECT raw_class, {CLASS_SQL} AS class_name FROM ann)
SELECT raw_class, class_name, count(*) AS n, CASE class_name WHEN 'No_Proliferativo' THEN 1 WHEN 'Proliferativo' THEN 2 WHEN 'Esclerosado' THEN 3 WHEN 'Excluido' THEN 4 ELSE 0 END AS class_id,
  CASE class_name WHEN 'No_Proliferativo' THEN 64 WHEN 'Proliferativo' THEN 128 WHEN 'Esclerosado' THEN 192 WHEN 'Excluido' THEN 255 ELSE 0 END AS gray FROM c GROUP BY raw_class, class_name"""


def class_gray(spark, sf_dir):
    a = annotations(spark, sf_dir).groupBy("raw_class").agg(F.count("*").alias("n"))
    gray = a.withColumn("gray", s.inference_gray(F.col("raw_class"))).withColumn("color", F.array_join(s.gray_color(s.inference_gray(F.col("raw_class"))), ","))
    return gray


CLASS_GRAY = f"""WITH ann AS ({ANN_SQL}), c AS (SELECT raw_class, count(*) AS n, {INFERENCE_GRAY_SQL} AS gray FROM ann GROUP BY raw_class)
SELECT raw_class, n, gray, CASE gray WHEN 64 THEN '0,255,0' WHEN 128 THEN '255,0,0' WHEN 192 THEN '255,165,0' WHEN 255 THEN '128,0,128' END AS color FROM c"""


def slide_bounds(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("slide").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


SLIDE_BOUNDS = f"WITH ann AS ({ANN_SQL}) SELECT slide, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ann GROUP BY slide"


def object_ids(spark, sf_dir):
    """Dense ids from 0 within each slide, and default names by ordinal; a slide may hold any share of the rows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = assign.dense_ids(annotations(spark, sf_dir).select("slide", "gid"), "slide", ["gid"], "id", parts)
    return a.select("slide", "gid", "id", F.concat(F.lit("glomeruli_"), (F.col("id") + 1).cast("string")).alias("name"))


OBJECT_IDS = f"WITH ann AS ({ANN_SQL}), i AS (SELECT slide, gid, CAST(row_number() OVER (PARTITION BY slide ORDER BY gid) - 1 AS BIGINT) AS id FROM ann) SELECT slide, gid, id, 'glomeruli_' || (id + 1) AS name FROM i"


def event_props(spark, sf_dir):
    """JSON properties read by path, a missing or broken document giving null."""
    e = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"))


EVENT_PROPS = "SELECT k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k"

QUERIES = {
    "tile_assignment": (tile_assignment, TILE_ASSIGNMENT),
    "tile_registry_roles": (tile_registry_roles, TILE_REGISTRY_ROLES),
    "tile_annotation_bbox": (tile_annotation_bbox, TILE_ANNOTATION_BBOX),
    "glom_tile_index": (glom_tile_index, GLOM_TILE_INDEX),
    "grid_training": (grid_training, GRID_TRAINING),
    "grid_inference": (grid_inference, GRID_INFERENCE),
    "tile_name_roundtrip": (tile_name_roundtrip, TILE_NAME_ROUNDTRIP),
    "centered_tiles": (centered_tiles, CENTERED_TILES),
    "coverage_index": (coverage_index, COVERAGE_INDEX),
    "dataset_summary": (dataset_summary, DATASET_SUMMARY),
    "polygon_metrics": (polygon_metrics, POLYGON_METRICS),
    "polygon_coverage": (polygon_coverage, POLYGON_COVERAGE),
    "crop_margin_manifest": (crop_margin_manifest, CROP_MARGIN_MANIFEST),
    "class_normalize": (class_normalize, CLASS_NORMALIZE),
    "class_gray": (class_gray, CLASS_GRAY),
    "slide_bounds": (slide_bounds, SLIDE_BOUNDS),
    "object_ids": (object_ids, OBJECT_IDS),
    "event_props": (event_props, EVENT_PROPS),
}
