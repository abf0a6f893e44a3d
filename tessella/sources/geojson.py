"""GeoJSON annotations as DataFrames, through Spark's text reader and the VARIANT functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import class_id, class_name
from ..operators.assign import dense_ids

RING = "array<array<double>>"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, size_bytes, doc): one row for each *.geojson; a file that is no JSON has doc null."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.geojson")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.url_decode(stem).alias("stem"), F.col("_metadata.file_size").alias("size_bytes"), F.try_parse_json("value").alias("doc"))


def features(files: DataFrame) -> DataFrame:
    """One row for each feature in file order: feature_index, kind (null for a missing geometry), name, raw_class.

    A classification is an object with a name, or a scalar (kept as text); without one the class is "unknown".
    """
    each = files.sparkSession.sql(
        "SELECT f.stem, e.pos AS feature_index, e.value AS feature FROM {files} f, LATERAL variant_explode_outer(variant_get(f.doc, '$.features', 'variant')) AS e WHERE e.pos IS NOT NULL",
        files=files,
    )
    get = lambda path, kind="string": F.try_variant_get("feature", path, kind)
    scalar = F.when(F.schema_of_variant(F.try_variant_get("feature", "$.properties.classification", "variant")).startswith("OBJECT"), None).otherwise(get("$.properties.classification"))
    return each.select(
        "stem", "feature_index", "feature",
        get("$.geometry.type").alias("kind"),
        F.coalesce(get("$.properties.name"), F.concat(F.lit("glomeruli_"), F.col("feature_index") + 1)).alias("name"),
        F.coalesce(get("$.properties.classification.name"), scalar, F.lit("unknown")).alias("raw_class"),
        get("$.properties.classification.color", "array<int>").alias("color"),
    )


def polygons(found: DataFrame, multi: bool = True, least: int = 3) -> DataFrame:
    """One row for each polygon with rings (the exterior first) and its exterior as ring; gid is dense by slide.

    Features without a usable shape, and rings of under least points, are left out. multi: parts of MultiPolygons too.
    """
    rings = lambda v: F.transform(v, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    one = F.when(F.col("kind") == "Polygon", F.array(rings(F.try_variant_get("feature", "$.geometry.coordinates", RING.replace("double", "array<double>")))))
    many = F.when(F.col("kind") == "MultiPolygon", F.transform(F.try_variant_get("feature", "$.geometry.coordinates", "array<array<array<array<double>>>>"), rings))
    parts = F.coalesce(one, many) if multi else one
    each = found.select("stem", "feature_index", "kind", "name", "raw_class", "color", F.posexplode(parts).alias("part", "rings"))
    each = each.withColumn("ring", F.get("rings", F.lit(0))).filter(F.size("ring") >= least)
    named = each.withColumn("class_name", class_name(F.col("raw_class"))).withColumn("class_id", class_id(F.col("class_name")))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dense_ids(named, "stem", ["feature_index", "part"], "gid", parts)


def bad_features(found: DataFrame) -> DataFrame:
    """Features by file that have no polygon geometry: skipped, but counted."""
    return found.filter(F.col("kind").isNull() | ~F.col("kind").isin("Polygon", "MultiPolygon")).groupBy("stem").agg(F.count("*").alias("bad_features"))


def bounds(files: DataFrame, shapes: DataFrame) -> DataFrame:
    """(stem, x0..y1): the file's bbox, else the bounds of its polygons, else zeros."""
    box = F.try_variant_get("doc", "$.bbox", "array<double>")
    xs, ys = F.col("ring.x"), F.col("ring.y")
    got = shapes.groupBy("stem").agg(F.min(F.array_min(xs)).alias("a"), F.min(F.array_min(ys)).alias("b"), F.max(F.array_max(xs)).alias("c"), F.max(F.array_max(ys)).alias("d"))
    named = files.select("stem", box.alias("box")).join(got, "stem", "left")
    pick = lambda i, c: F.coalesce(F.get("box", F.lit(i)), F.col(c), F.lit(0.0))
    return named.select("stem", pick(0, "a").alias("x0"), pick(1, "b").alias("y0"), pick(2, "c").alias("x1"), pick(3, "d").alias("y1"))


def match_slides(slides: DataFrame, files: DataFrame) -> DataFrame:
    """slides (stem) with the path of their annotations: the file of the same stem, else the first by path whose stem
    contains the slide's, else null. Only slides without an exact file take part in the search by substring."""
    exact = slides.join(files.select("stem", F.col("path").alias("annotation")), "stem", "left")
    open_ = exact.filter("annotation is null").select("stem").distinct()
    near = open_.join(files.select(F.col("stem").alias("__s"), "path"), F.col("__s").contains(F.col("stem"))).groupBy("stem").agg(F.min("path").alias("__near"))
    return exact.join(near, "stem", "left").withColumn("annotation", F.coalesce("annotation", "__near")).drop("__near")


def pair_by_stem(images: DataFrame, files: DataFrame, first: Column | None = None) -> DataFrame:
    """Slides with annotations of the same stem; with first, images of one stem give only the one that sorts first."""
    if first is not None:
        images = images.groupBy("stem").agg(F.min_by("path", F.struct(first, F.col("path"))).alias("path"))
    return images.join(files.select("stem", F.col("path").alias("annotation")), "stem")
