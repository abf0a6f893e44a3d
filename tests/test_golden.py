"""Hand-computed cases for operators and functions, and round trips through files."""

import json
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import TilingConfig
from tessella.functions import geometry as g
from tessella.functions import scalars as s
from tessella.operators import assign, grid, inference, metrics, raster, splits, stats
from tessella.sources import geojson, images, sinks
from tessella.streaming import ingest


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
CONCAVE = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]
BOW = [(0, 0), (10, 10), (10, 0), (0, 10)]


@pytest.mark.parametrize("w,h,n,last", [(5000, 3000, 6, (2952, 952)), (2048, 2048, 1, (0, 0)), (2047, 9000, 0, None), (4096, 2048, 2, (2048, 0))])
def test_training_grid(spark, w, h, n, last):
    tiles = grid.training_grid(one(spark, width=w, height=h).select(F.col("width").cast("int"), F.col("height").cast("int")), 2048, 2048).orderBy("tile_idx").collect()
    assert len(tiles) == n and [t.tile_idx for t in tiles] == list(range(n))
    assert not n or (tiles[-1].x0, tiles[-1].y0) == last


def test_inference_grid_clips(spark):
    tiles = grid.inference_grid(spark.range(1).select(F.lit(100).alias("width"), F.lit(50).alias("height")), 64, 48).orderBy("tile_idx").collect()
    assert [(t.x0, t.y0, t.x1, t.y1) for t in tiles] == [(0, 0, 64, 50), (48, 0, 100, 50), (96, 0, 100, 50), (0, 48, 64, 50), (48, 48, 100, 50), (96, 48, 100, 50)]


def test_box_join_touching_and_binning(spark):
    rng = random.Random(5)
    objects = [(i, *(lambda x, y, a, b: (x, y, x + a, y + b))(*(float(rng.randint(0, 40)) for _ in range(4)))) for i in range(60)]
    tiles = [(k, 8 * (k % 8), 8 * (k // 8), 8 * (k % 8) + 8, 8 * (k // 8) + 8) for k in range(64)]
    o = spark.createDataFrame(objects, "gid int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame(tiles, "tile_idx int, x0 int, y0 int, x1 int, y1 int")
    for inclusive in (False, True):
        for cell in (5, 8, 30):
            got = sorted((r.gid, r.tile_idx) for r in grid.box_join(o, t, cell, inclusive, small_tiles=64).collect())
            touch = (lambda a, b: a <= b) if inclusive else (lambda a, b: a < b)
            want = sorted((i, k) for i, a, b, c, d in objects for k, e, f, u, v in tiles if touch(a, u) and touch(e, c) and touch(b, v) and touch(f, d))
            assert got == want


def test_assignment_threshold_and_ties(spark):
    pairs = spark.createDataFrame([(1, 5, 60.0), (1, 2, 30.0), (2, 7, 50.0), (2, 3, 50.0), (3, 1, 59.999)], "gid int, tile_idx int, coverage double")
    objects = spark.createDataFrame([(1,), (2,), (3,), (4,)], "gid int")
    a = {r.gid: r for r in assign.primary_secondary(objects, pairs, ["gid"]).collect()}
    assert (a[1].primary_tile, a[1].secondary_tile, a[1].primary_is_centered, a[1].primary_coverage) == (5, 2, False, 60.0)
    assert (a[2].primary_tile, a[2].secondary_tile, a[2].primary_is_centered, a[2].primary_coverage, a[2].secondary_coverage) == (None, 3, True, 0.0, 50.0)
    assert (a[3].secondary_tile, a[3].primary_is_centered) == (1, True)
    assert (a[4].secondary_tile, a[4].primary_is_centered, a[4].secondary_coverage) == (None, True, 0.0)
    b = {r.gid: (r.primary_tile, r.secondary_tile) for r in assign.ranked_assignment(pairs, ["gid"], []).collect()}
    assert b == {k: (a[k].primary_tile, a[k].secondary_tile) for k in (1, 2, 3)}


@pytest.mark.parametrize("raw,name,cid,gray,bucket", [
    (" No Prolif", "No_Proliferativo", 1, 64, "No_Proliferativo"), ("prolif", "Proliferativo", 2, 128, None), ("Excluido", "Excluido", 4, 255, None),
    ("sclerotic", "Esclerosado", 3, 64, None), ("Tissue", "Tissue", 0, 64, None), ("exclude", "Excluido", 4, 255, "Excluyente"), ("background", "background", 0, 64, None),
    ("Proliferativo", "Proliferativo", 2, 128, "Proliferativo"),
])
def test_classes(spark, raw, name, cid, gray, bucket):
    r = one(spark, c=raw).select(s.class_name(F.col("c")).alias("n"), s.class_id(s.class_name(F.col("c"))).alias("i"), s.inference_gray(F.col("c")).alias("g"), s.class_bucket(F.col("c")).alias("b")).first()
    assert tuple(r) == (name, cid, gray, bucket)


def test_names_and_paths(spark):
    name = s.tile_name(*map(F.lit, ("a_tile_b", 1, 22, 1025, 1046)))
    r = spark.range(1).select(name.alias("n")).select("n", s.parse_tile_name(F.col("n")).alias("t"), s.biopsy_of_tile(F.col("n")).alias("b")).first()
    assert r.n == "a_tile_b_tile_x00001_y00022_endx01025_endy01046" and r.b == "a_tile_b"
    assert tuple(r.t) == ("a_tile_b", 1, 22, 1025, 1046, 1024, 1024)
    assert value(spark, s.parse_tile_name(F.lit("s_centered_g0001"))) is None
    for path, biopsy in (("b1/images/t.png", "b1"), ("x/y/images/t.png", "y"), ("p/t.png", "p"), ("t.png", "t")):
        assert value(spark, s.biopsy_of_path(F.lit(path))) == biopsy
    mb = 1024 * 1024
    for path, size, fmt in (("a.tif", 300 * mb, "pil"), ("a.TIFF", 300 * mb + 1, "openslide"), ("a.svs", 1, "openslide"), ("a.jpg", 1, "pil"), ("a.txt", 1, None)):
        assert value(spark, s.slide_format(F.lit(path), F.lit(size))) == fmt


@pytest.mark.parametrize("size,tile", [(128, 128), (128.01, 256), (9999, 2560), (1, 128), (2560, 2560)])
def test_recommended_tile(spark, size, tile):
    assert value(spark, s.recommended_tile(F.lit(float(size)))) == tile


def test_small_scalars(spark):
    assert value(spark, s.canvas_length(F.lit(1023), 0.5, 10)) == 204
    assert value(spark, s.canvas_length(F.lit(1), 0.5, 10, floor_first=False)) == 1
    assert tuple(value(spark, s.pad_box(*map(F.lit, (5, 50, 100, 120)), F.lit(105), F.lit(500)))) == (0, 40, 105, 130)
    assert tuple(value(spark, s.expand_margin(*map(F.lit, (1.0, 100.0, 11.0, 140.0)), 0.5))) == (0.0, 80.0, 31.0, 160.0)
    assert value(spark, s.tile_to_native(F.lit(1000), F.lit(10), 0.5)) == 1020
    assert value(spark, s.argmax(F.array(*map(F.lit, (1.0, 3.0, 3.0))))) == 1
    assert value(spark, s.gray_color(F.lit(192))) == [255, 165, 0] and value(spark, s.gray_color(F.lit(7))) == [7, 7, 7]
    assert value(spark, s.rgb_to_gray(F.lit(10), F.lit(20), F.lit(30))) == 18
    assert s.class_gray_lut()[:6] == [0, 64, 128, 192, 255, 0]
    assert value(spark, s.apply_lut(F.array(F.lit(0), F.lit(4)), s.class_gray_lut())) == [0, 255]
    assert value(spark, s.overlay(F.lit(255), F.lit(0), F.lit(1))) == 180 and value(spark, s.overlay(F.lit(255), F.lit(9), F.lit(0))) == 9


def test_geometry(spark):
    for points, area, perimeter, mid in ((SQUARE, 100, 40, (5, 5)), (CONCAVE, 75, 30 + 2 * math.hypot(5, 5), (5, 3.888889))):
        r = spark.range(1).select(ring(points).alias("r")).select(g.area(F.col("r")).alias("a"), g.perimeter(F.col("r")).alias("p"), g.centroid(F.col("r")).alias("c")).first()
        assert r.a == area and r.p == pytest.approx(perimeter)
        assert (r.c.x, r.c.y) == pytest.approx(mid, abs=1e-5)
    assert value(spark, g.coverage_pct(ring(CONCAVE), *map(F.lit, (0.0, 5.0, 10.0, 10.0)))) == pytest.approx(100 / 3)
    assert value(spark, g.coverage_pct(ring(SQUARE), *map(F.lit, (10.0, 0.0, 20.0, 10.0)))) == 0
    assert value(spark, g.coverage_pct(ring([(1, 1), (1, 1), (1, 1)]), *map(F.lit, (0.0, 0.0, 9.0, 9.0)))) == 0
    assert value(spark, g.area_with_holes(F.array(ring(SQUARE), ring([(2, 2), (4, 2), (4, 4), (2, 4)])))) == 96
    assert value(spark, g.crosses_itself(ring(BOW))) and not value(spark, g.crosses_itself(ring(CONCAVE)))
    assert value(spark, g.circularity(F.lit(1.0), F.lit(0.0))) == 0
    assert [tuple(p) for p in value(spark, g.clamp(ring(SQUARE), *map(F.lit, (2.0, 2.0, 5.0, 5.0))))] == [(2, 2), (5, 2), (5, 5), (2, 5)]


def test_clip_area_of_random_polygons(spark):
    """Star-shaped polygons against point sampling."""
    rng = np.random.default_rng(1)
    shapes = []
    for i in range(8):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(3, 10, 9)
        shapes.append((i, [(float(10 + a * np.cos(t)), float(10 + a * np.sin(t))) for a, t in zip(r, angle, strict=True)]))
    df = spark.createDataFrame(shapes, "i int, ring array<struct<x:double,y:double>>")
    got = {r.i: r.c for r in df.select("i", g.area(g.clip(F.col("ring"), *map(F.lit, (5.0, 6.0, 14.0, 12.0)))).alias("c")).collect()}
    pts = rng.uniform((5, 6), (14, 12), (40_000, 2))
    for i, points in shapes:
        inside = np.zeros(len(pts), bool)
        for (a, b), (c, d) in zip(points, points[1:] + points[:1], strict=True):
            hit = (b > pts[:, 1]) != (d > pts[:, 1])
            inside ^= hit & (pts[:, 0] < (c - a) * (pts[:, 1] - b) / (d - b + 1e-300) + a)
        assert got[i] == pytest.approx(inside.mean() * 54, abs=1.0)


@pytest.mark.parametrize("n,sizes", [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (20, (13, 3, 4))])
def test_permutation_split(n, sizes):
    parts = splits.permutation_split([f"b{i:02d}" for i in range(n)])
    assert tuple(len(parts[k]) for k in ("train", "val", "test")) == sizes
    assert sorted(sum(parts.values(), [])) == [f"b{i:02d}" for i in range(n)]


def test_split_checks(spark):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(40)], "b string")
    made = splits.hash_split(groups, "b")
    assert made.count() == 40 and all(r.shared == 0 for r in splits.overlaps(made, "b").collect())
    leaky = made.unionByName(made.filter("split = 'train'").withColumn("split", F.lit("test")))
    assert splits.overlaps(leaky, "b").filter("shared > 0").count() == 1
    assert {r.check: r.ok for r in splits.checks(made, groups.limit(0), "b").collect()} == {"disjoint": True, "not_empty": True, "tiles_present": False}
    assert value(spark, splits.missing_keys(F.array(F.lit("seed"), F.lit("train")))) == ["train_size", "val_size", "test_size", "total_biopsies", "val", "test"]


def test_scores_without_positives(spark):
    df = spark.createDataFrame([("t", 0, 0), ("u", 1, 1), ("u", 0, 1)], "tile string, truth int, pred int")
    got = {r.tile: (r.iou, r.f1, r.precision, r.recall) for r in metrics.binary_scores(df, ["tile"]).collect()}
    assert got == {"t": (0, 0, 0, 0), "u": (0.5, pytest.approx(2 / 3), 0.5, 1.0)}


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)], "k string, v double")
    got = {r.k: r for r in stats.spread(df, ["v"], ["k"]).collect()}
    assert got["a"].std_v == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and got["b"].std_v is None
    p = {(r.k, r.pct): r.value for r in stats.percentiles(df, "v", ["k"]).collect()}
    assert p[("a", 75)] == np.percentile([1, 2, 3, 4], 75) and p[("b", 50)] == 7
    rec = stats.recommendation(df, "v", ["k"])
    assert stats.text_report(rec, "k").filter("line LIKE '%only%'").count() == 10


def test_dense_kernels():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (12, 9, 3), dtype=np.uint8)
    assert (raster.resize(a, 12, 9, "linear") == a).all() and (raster.resize_nearest(a, 24, 18)[::2, ::2] == a).all()
    assert raster.crop_square(np.zeros((30, 10), np.uint8), 8, cap=16).shape == (8, 8)
    tile = raster.extract_tile(a, 5, 10, 6)
    assert (tile[:2, :4] == a[10:, 5:]).all() and (tile[2:] == 255).all() and (tile[:, 4:] == 255).all()
    white = np.full((20, 20, 3), 255, np.uint8)
    assert (raster.color_transfer(white.ravel(), 20, 20) == white).all()
    moved = raster.color_transfer(rng.integers(40, 160, 40 * 40 * 3, dtype=np.uint8), 40, 40)
    assert moved.reshape(-1, 3).mean(axis=0) / 255 == pytest.approx([0.485, 0.456, 0.406], abs=0.02)
    mask = raster.fill_polygon(np.array([1.0, 6, 6, 1]), np.array([1.0, 1, 6, 6]), 8)
    assert mask[1:6, 1:6].all() and mask.sum() <= 36


def test_components_and_separation():
    mask = np.zeros((9, 9), bool)
    mask[0, :] = mask[:, 8] = True
    mask[4:7, 2:4] = True
    label = raster.label_components(mask)
    assert label.max() == 2 and label[0, 0] == label[8, 8] == 1 and label[5, 2] == 2
    yy, xx = np.mgrid[:60, :90]
    two = ((yy - 30) ** 2 + (xx - 28) ** 2 < 400) | ((yy - 30) ** 2 + (xx - 62) ** 2 < 400)
    parts = raster.separate(two)
    assert parts.max() == 2 and parts[30, 20] != parts[30, 70]
    assert raster.separate(np.zeros((20, 20), bool)).max() == 0


def test_tissue_mask():
    image = np.full((400, 400, 3), 240, np.uint8)
    image[100:300, 100:300] = (200, 60, 120)
    mask = raster.tissue_mask(image, 20)
    assert mask.shape == (20, 20) and mask[10, 10] == 255 and mask[1, 1] == 0 and 80 <= (mask > 0).sum() <= 120
    assert raster.otsu_threshold(np.array([0, 0, 200, 201], np.uint8)) == 0
    assert raster.box_mask(4, 5, 1, 2, 3, 4).sum() == 4 * 255


def test_segmentation_of_tiles(spark):
    yy, xx = np.mgrid[:96, :96]
    disc = (yy - 40) ** 2 + (xx - 50) ** 2 < 500
    image = np.where(disc[:, :, None], (200, 30, 90), (120, 180, 160)).astype(np.uint8)
    df = spark.createDataFrame([("t1", bytearray(image.tobytes()), 96, 96), ("t2", None, 96, 96)], "tile string, data binary, h int, w int")
    found = inference.segment(df, lambda batch: 10 * batch[:, 0], ["tile"], "data", "h", "w", side=96, least=100).collect()
    assert [r.tile for r in found] == ["t1"] and found[0].area == pytest.approx(disc.sum(), rel=0.1)
    assert abs(found[0].x_min - 28) <= 3 and abs(found[0].y_max - 62) <= 3


def test_index_and_manifest_documents(spark, tmp_path):
    pairs = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 2, "b")], "slide string, gid int, tile string")
    doc = json.loads(sinks.index_documents(pairs, "slide", "gid", "tile").first().json)
    assert doc == {"glomeruli": [{"gid": 1, "tiles": ["a", "b"]}, {"gid": 2, "tiles": ["b"]}], "tile_to_glomeruli": {"a": [1], "b": [1, 2]}}
    made = sinks.manifest_documents(pairs.filter("tile = 'b'"), "slide", "gid", F.struct("tile"))
    sinks.write_documents(made, str(tmp_path / "m"), "slide")
    back = sinks.read_documents(spark, str(tmp_path / "m"), "features map<string,struct<tile:string>>").first()
    assert {k: v.tile for k, v in back.doc.features.items()} == {"0001": "b", "0002": "b"} and back.slide == "s"
    both = splits.shared_split(spark, pairs.select("tile"), pairs.filter("gid = 2").select("tile"), "tile")
    assert [tuple(r) for r in both.collect()] == [("b", "train")]
    files = spark.createDataFrame([("a/x.TIF",), ("a/y.png",)], "path string")
    assert images.of_formats(files, (".tif",)).count() == 1 and images.of_formats(files, None).count() == 2


def test_config_layers(tmp_path):
    (tmp_path / "c.yaml").write_text("tile_size: 512\ntissue_filter:\n  bg_threshold: 9.5\nother: 1\n")
    c = TilingConfig.from_yaml(str(tmp_path / "c.yaml"), zoom_scale=0.25, stride=None)
    assert (c.tile_size, c.bg_threshold, c.zoom_scale, c.stride, c.native_tile) == (512, 9.5, 0.25, 1024, 2048)
    assert TilingConfig.from_yaml(str(tmp_path / "none.yaml")) == TilingConfig()


GEO = {"type": "FeatureCollection", "features": [
    {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]]}, "properties": {"name": "one", "classification": {"name": " No Prolif", "color": [1, 2, 3]}}},
    {"geometry": None, "properties": {}},
    {"geometry": {"type": "MultiPolygon", "coordinates": [[[[20, 20], [30, 20], [30, 30]]], [[[40, 40], [50, 40], [50, 50]]]]}, "properties": {"classification": "sclerotic"}},
    {"geometry": {"type": "Point", "coordinates": [1, 1]}, "properties": None},
    {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}, "properties": None},
]}


def test_geojson(spark, tmp_path):
    (tmp_path / "s 1.geojson").write_text(json.dumps(GEO))
    (tmp_path / "s2_ann.geojson").write_text(json.dumps({"bbox": [1, 2, 3, 4], "features": []}))
    (tmp_path / "bad.geojson").write_text("{")
    files = geojson.read_files(spark, str(tmp_path))
    found = geojson.features(files)
    p = geojson.polygons(found).orderBy("gid").collect()
    assert [(r.feature_index, r.part, r.gid, r.class_name, r.class_id) for r in p] == [(0, 0, 0, "No_Proliferativo", 1), (2, 0, 1, "Esclerosado", 3), (2, 1, 2, "Esclerosado", 3)]
    assert p[0].name == "one" and p[1].name == "glomeruli_3" and len(p[0].rings) == 2 and p[0].color == [1, 2, 3]
    assert {r.stem: r.bad_features for r in geojson.bad_features(found).collect()} == {"s 1": 2}
    b = {r.stem: (r.x0, r.y0, r.x1, r.y1) for r in geojson.bounds(files, geojson.polygons(found)).collect()}
    assert b == {"s 1": (0, 0, 50, 50), "s2_ann": (1, 2, 3, 4), "bad": (0, 0, 0, 0)}
    slides = spark.createDataFrame([("s 1",), ("s2",), ("zzz",)], "stem string")
    m = {r.stem: r.annotation for r in geojson.match_slides(slides, files).collect()}
    assert m["s 1"].endswith("s%201.geojson") and m["s2"].endswith("s2_ann.geojson") and m["zzz"] is None
    one_ = geojson.pair_by_stem(spark.createDataFrame([("s 1", "s 1.tiff"), ("s 1", "s 1.tif")], "stem string, path string"), files, F.when(F.col("path").endswith(".tif"), 0).otherwise(1))
    assert [r.path for r in one_.collect()] == ["s 1.tif"]


def test_tiles_to_files_and_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (8, 6, 3), dtype=np.uint8)
    folder = str(tmp_path / "b1/images")
    df = spark.createDataFrame([("s_tile_x00000_y00000_endx00006_endy00008.png", bytearray(pixels.tobytes()), 8, 6)], "name string, data binary, h int, w int")
    report = sinks.write_blobs(sinks.with_png(df, "data", "h", "w"), folder, "name", "png").collect()
    assert report[0].bytes > 50
    back = images.pixels(spark, folder).first()
    assert (back.height, back.width) == (8, 6)
    assert (np.frombuffer(back.data, np.uint8).reshape(8, 6, 3)[:, :, ::-1] == pixels).all()
    files = images.listing(spark, str(tmp_path), "*.png", recursive=True)
    t = images.tiles(files).first()
    assert (t.slide, t.x1, t.y1) == ("s", 6, 8)
    assert [r.biopsy for r in images.tiles_by_biopsy(files, str(tmp_path)).collect()] == ["b1"]
    assert images.complete_biopsies(files, str(tmp_path)).count() == 0


def test_dense_ids_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(900)] + [("b", 5), ("b", 3), (None, 1)]
    df = spark.createDataFrame(rows, "slide string, gid int").repartition(5)
    got = {(r.slide, r.gid): r.id for r in assign.dense_ids(df, "slide", ["gid"], "id", 16).collect()}
    assert got == {("hot", i): i for i in range(900)} | {("b", 3): 0, ("b", 5): 1, (None, 1): 0}
    f = df.withColumn("feature", F.struct("gid"))
    parts = sinks.feature_collections(f, "slide", "gid", per_document=100).collect()
    assert sum(len(json.loads(r.json)["features"]) for r in parts) == 903 and max(len(json.loads(r.json)["features"]) for r in parts) < 200


def test_documents_and_splits_on_disk(spark, tmp_path):
    f = sinks.feature(sinks.rectangle(*map(F.lit, (0, 0, 2, 3))), F.struct(F.lit(1).alias("id")))
    row = sinks.feature_collections(spark.range(2).select(F.lit("s").alias("slide"), F.col("id").alias("gid"), f.alias("feature")), "slide", "gid").first()
    doc = json.loads(row.json)
    assert doc["type"] == "FeatureCollection" and len(doc["features"]) == 2 and doc["features"][0]["geometry"]["coordinates"] == [[[0, 0], [2, 0], [2, 3], [0, 3], [0, 0]]]
    made = splits.permutation_frame(spark, spark.createDataFrame([(f"b{i}",) for i in range(5)], "b string"), "b")
    sinks.write_split(made, str(tmp_path / "split"), "b", 42, (0.7, 0.15, 0.15))
    record = spark.read.json(str(tmp_path / "split")).first().asDict()
    assert set(splits.REQUIRED) <= set(record) and record["total_biopsies"] == 5
    sinks.write_csv(made, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5


def test_predict_skips_broken_rows(spark):
    good = bytearray(np.random.default_rng(4).integers(0, 256, 20 * 20 * 3, dtype=np.uint8).tobytes())
    df = spark.createDataFrame([(1, good, 20, 20), (2, bytearray(b"xx"), 20, 20), (3, None, 20, 20)], "id int, data binary, h int, w int")
    model = inference.linear_model(np.eye(3), np.zeros(3))
    got = {r.id: r for r in inference.classified(inference.predict(df, model, "data", "h", "w", side=16), "logits", ("a", "b", "c")).collect()}
    assert len(got[1].logits) == 3 and got[1]["class"] in "abc" and got[2].logits is None and got[3].logits is None


def test_detections(spark):
    found = spark.createDataFrame([(1, 5, 20, 30, 40)], "label int, x_min int, y_min int, x_max int, y_max int")
    r = inference.detections(found, F.lit(1000), F.lit(2000), 1024).first()
    assert tuple(r.bbox_tile) == (0, 10, 40, 50) and tuple(r.bbox_native) == (1000, 2010, 1040, 2050)


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.once_each(ingest.events(spark, str(tmp_path / "in"), source.schema.simpleString()[7:-1].replace(":", " "), 10), "event_id", late="1000 days")
    q = ingest.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.select("event_id").distinct().count()
    rates = ingest.class_rates(ingest.events(spark, str(tmp_path / "in"), source.schema.simpleString()[7:-1].replace(":", " ")), late="1000 days")
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == source.count()


def test_entry_stands_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(q[:2] == 'op' for q in e.queries()); print(len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0


def test_masks_of_both_tilers():
    xs, ys = np.array([-5.0, 30.0, 30.0, -5.0]), np.array([4.0, 4.0, 12.0, 12.0])
    made = raster.training_mask(xs, ys, (0, 0, 20, 20), 10, 0.5)
    want = np.zeros((10, 10), bool)
    want[2:7, :] = True
    assert (made == want).all()
    assert not raster.training_mask(xs + 100, ys, (0, 0, 20, 20), 10, 0.5).any()
    moved = raster.inference_mask(np.array([102.0, 130.0, 110.0]), np.array([203.0, 203.0, 240.0]), 100, 200, 20, 20)
    assert moved[3, 2:].all() and moved[19, 10:20].any() and not moved[:3].any()
    assert raster.inference_mask(np.array([102.0, 130.0, 110.0]), np.array([203.0, 203.0, 240.0]), 100, 200, 20, 10).shape == (10, 10)


def test_alpha_paste_canvas_cap_and_classifier_input():
    from tessella.operators import inference

    rgba = np.zeros((2, 2, 4), np.uint8)
    rgba[0, 0], rgba[0, 1], rgba[1, 0] = (10, 20, 30, 255), (10, 20, 30, 0), (0, 100, 200, 128)
    tile = raster.extract_tile(rgba, 0, 0, 3, paste=True)
    assert tile[0, 0].tolist() == [10, 20, 30] and tile[0, 1].tolist() == [255] * 3 and tile[1, 0].tolist() == [127, 177, 227] and tile[2, 2].tolist() == [255] * 3
    assert raster.extract_tile(rgba, 0, 0, 2)[0, 1].tolist() == [10, 20, 30]
    assert raster.capped(np.zeros((30, 90), np.uint8), 45).shape == (15, 45) and raster.capped(np.zeros((3, 9)), 45).shape == (3, 9)
    crop = np.random.default_rng(1).integers(0, 256, (50, 70, 3), dtype=np.uint8)
    mask = np.zeros((50, 70), np.uint8)
    mask[10:40, 20:60] = 255
    made = inference.classifier_input(crop, mask)
    assert made.shape == (4, 128, 128) and abs(made[:3].mean()) < 1e-4 and abs(made[:3].std() - 1) < 1e-3 and set(np.unique(made[3][:20])) == {0.0} and made[3][64, 64] == 1


def test_resumed_documents_keep_what_is_done(spark, tmp_path):
    folder = str(tmp_path / "slides")
    assert sinks.completed(spark, folder, "slide").collect() == []
    docs = spark.createDataFrame([("s1", "{}"), ("s2", "{}"), ("s 3/x", "{}")], "slide string, json string")
    sinks.write_documents(docs.filter("slide <> 's2'"), folder, "slide")
    done = sinks.completed(spark, folder, "slide")
    assert {r.slide for r in done.collect()} == {"s1", "s 3/x"}
    from tessella.operators import splits

    sinks.write_documents(splits.not_done(docs, done, "slide"), folder, "slide")
    assert {r.slide for r in sinks.completed(spark, folder, "slide").collect()} == {"s1", "s2", "s 3/x"}
    assert sinks.read_documents(spark, folder, "a int").count() == 3


def test_percentiles_by_ranges_equal_sorting(spark):
    from tessella.operators import stats

    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=999), "b": np.r_[np.zeros(500), 1e9, -3.5], "c": np.array([7.0]), "d": np.repeat([1.0, 2.0], 50)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    got = {(r.k, r.pct): r.value for r in stats.percentiles(df, "v", ["k"], (0, 5, 50, 95, 100)).collect()}
    assert got == pytest.approx({(k, p): float(np.percentile(v, p)) for k, v in values.items() for p in (0, 5, 50, 95, 100)})


def test_annotation_records_of_many_parts(spark):
    heads = spark.createDataFrame([("s", 5), ("t", 6)], "slide string, width int")
    tiles = spark.range(30).selectExpr("'s' AS slide", "id AS o", "named_struct('n', id) AS entry")
    objects = spark.range(8).selectExpr("'s' AS slide", "id AS gid", "named_struct('class', 'x') AS entry")
    docs = [(r.slide, json.loads(r.json)) for r in sinks.annotations_documents(heads, tiles, objects, per_document=10).collect()]
    mine = [d for s, d in docs if s == "s"]
    assert len(mine) == 4 and all(d["width"] == 5 and d["parts"] == 4 for d in mine)
    assert sorted(t["n"] for d in mine for t in d["tiles"]) == list(range(30)) and sorted(k for d in mine for k in d["glomeruli_coverage"]) == [str(i) for i in range(8)]
    assert [d for s, d in docs if s == "t"] == [{"slide": "t", "width": 6, "part": 0, "parts": 1, "glomeruli_coverage": {}, "tiles": []}]


def test_deviation_on_the_threshold_is_that_of_sql(spark, tmp_path):
    import duckdb

    from oracle import duck_rows
    from tessella.registry import ORACLE_SQL, QUERIES

    # Variance of exactly 676: 64 values whose sums give 64 * s2 - s1 * s1 = 1664 * 1664. SQL's running means miss 26 by rounding in some orders.
    rng, rows = np.random.default_rng(3), []
    while len(rows) < 40:
        x = np.clip(np.rint(rng.normal(127, 26, (20_000, 64))), 0, 255).astype(int)
        rows += x[64 * (x * x).sum(axis=1) - x.sum(axis=1) ** 2 == 1664 * 1664].tolist()
    vectors = [[(v + 0.5) / 255 * 1.2 - 0.6 for v in x] for x in rows]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").withColumn("label", F.lit(0))
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names, want = duck_rows(con, ORACLE_SQL["patch_background_filter"])
    got = {r.vec_id: r.background for r in QUERIES["patch_background_filter"](spark, str(tmp_path)).collect()}
    assert got == {r[names.index("vec_id")]: r[names.index("background")] for r in want} and set(got.values()) == {True, False}


def test_records_of_a_dense_slide_are_many_small_documents(spark, tmp_path):
    import gzip
    from pathlib import Path

    from oracle import duck_rows, spark_rows
    from tessella import runtime
    from tessella.registry import ORACLE_SQL, QUERIES

    events = spark.range(12_000).selectExpr("id AS event_id", "id % 2 * 7 AS user_id", "element_at(array('click', 'view', 'purchase', 'error', 'signup'), cast(id % 5 + 1 AS int)) AS event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb_of(tmp_path, "events")
    old = set(Path(runtime.shared_dir(spark)).glob("records-*"))
    for name in ("annotation_records", "dataset_totals"):
        got, want = spark_rows(QUERIES[name](spark, str(tmp_path))), duck_rows(con, ORACLE_SQL[name])
        assert got[0] == want[0] and all(a == pytest.approx(b, abs=2e-3) for a, b in zip(got[1], want[1], strict=True))
    made = [p for d in set(Path(runtime.shared_dir(spark)).glob("records-*")) - old for p in d.glob("slide=*/part-*")]
    longest = max(len(line) for p in made for line in (gzip.open(p) if p.suffix == ".gz" else p.open("rb")))
    assert 10_000 < longest < 3_000_000


def test_lists_are_written_where_their_objects_lie(spark, tmp_path):
    from tessella.bridge import annotations
    from tessella.functions import scalars
    from tessella.plans import files

    events = spark.range(2500).selectExpr("id * 37 AS event_id", "id % 2 * 7 AS user_id", "element_at(array('click', 'view', 'purchase', 'error', 'other'), cast(id % 5 + 1 AS int)) AS event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path / "records")
    assert files._write(spark, str(tmp_path), folder, [0, 7]) == ["slide=0", "slide=7"]
    assert sorted(p.name for p in Path(folder).iterdir()) == ["slide=0", "slide=7"]
    boxes = annotations(spark, str(tmp_path)).withColumn("c", scalars.class_name(F.col("raw_class"))).collect()
    for w in (0, 7):
        docs = [json.loads(r.value) for r in spark.read.text(f"{folder}/slide={w}").collect()]
        assert sorted(d["part"] for d in docs) == list(range(len(docs))) and {d["parts"] for d in docs} == {len(docs)} and {d["n_glomeruli"] for d in docs} == {1250}
        tiles = [t for d in docs for t in d["tiles"]]
        centers = {t["glomerulus_id"]: t for t in tiles if t["type"] == "centered"}
        assert len(centers) == docs[0]["n_centered_tiles"] > 20 and sum(t["type"] == "grid" for t in tiles) == 100 and len(tiles) == 100 + len(centers)
        for own, t in centers.items():
            a, b, c, d = t["bbox_native"]
            share = {r.gid: max(0.0, min(r.x1, c) - max(r.x0, a)) * max(0.0, min(r.y1, d) - max(r.y0, b)) / ((r.x1 - r.x0) * (r.y1 - r.y0)) * 100 for r in boxes if r.slide == w}
            kind = {r.gid: {"class": r.c} if r.c else {} for r in boxes}
            assert t["glomeruli"] == [{"id": g, **kind[g], "coverage_pct": v, "role": "primary" if g == own else "secondary"} for g, v in sorted(share.items()) if v > 0]
            assert t["has_annotations"] and t["origin_native"] == [a, b] and t["image"] == f"images/slide_{w}_centered_g{own:04d}.png"


def test_records_that_were_read_leave_the_disk(spark, tmp_path, monkeypatch):
    from oracle import duck_rows, spark_rows
    from tessella import runtime
    from tessella.plans import files
    from tessella.registry import ORACLE_SQL, QUERIES

    events = spark.range(600).selectExpr("id AS event_id", "id % 3 * 7 AS user_id", "element_at(array('click', 'view', 'purchase', 'error', 'signup'), cast(id % 5 + 1 AS int)) AS event_type")
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb_of(tmp_path, "events")
    monkeypatch.setattr(files, "KEPT", 0)
    monkeypatch.setattr(files, "WAVE_OBJECTS", 250)
    old = set(Path(runtime.shared_dir(spark)).glob("records-*"))
    for name in ("annotation_records", "dataset_totals"):
        got, want = spark_rows(QUERIES[name](spark, str(tmp_path))), duck_rows(con, ORACLE_SQL[name])
        assert got[0] == want[0] and all(a == pytest.approx(b, abs=2e-3) for a, b in zip(got[1], want[1], strict=True))
    for d in set(Path(runtime.shared_dir(spark)).glob("records-*")) - old:
        assert {p.name for p in d.rglob("*") if p.is_file() and not p.name.endswith(".crc")} == {"_SUCCESS"}
        assert {r.slide for r in sinks.completed(spark, str(d), "slide").collect()} == {str(w) for w in range(20)}


def duckdb_of(folder, *tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con
