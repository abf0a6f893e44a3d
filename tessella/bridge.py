"""The driver's tables as domain views: annotations, polygons, patches, segmentation pairs, biopsies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLIDE = 20_000
SLIDES = 20
TILE = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotated box for each event: gid, slide, x0..y1 (native px), raw_class."""
    e = F.col("event_id")
    x0, y0 = (e * 7919 % 19000).cast("double"), (e * 104729 % 19000).cast("double")
    raw = F.create_map(*[F.lit(v) for pair in RAW_CLASSES.items() for v in pair])
    return table(spark, sf_dir, "events").select(
        e.alias("gid"),
        (F.col("user_id") % SLIDES).alias("slide"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 100 + e % 700).alias("x1"),
        (y0 + 100 + e % 500).alias("y1"),
        raw[F.col("event_type")].alias("raw_class"),
    )


RAW_CLASSES = {"click": " No Prolif", "view": "Proliferativo", "purchase": "ESCLEROSADO", "error": "exclude", "signup": "artefacto"}

ANN_SQL = """SELECT event_id AS gid, user_id % 20 AS slide,
  CAST((event_id * 7919) % 19000 AS DOUBLE) AS x0, CAST((event_id * 104729) % 19000 AS DOUBLE) AS y0,
  CAST((event_id * 7919) % 19000 + 100 + event_id % 700 AS DOUBLE) AS x1,
  CAST((event_id * 104729) % 19000 + 100 + event_id % 500 AS DOUBLE) AS y1,
  CASE event_type WHEN 'click' THEN ' No Prolif' WHEN 'view' THEN 'Proliferativo' WHEN 'purchase' THEN 'ESCLEROSADO'
    WHEN 'error' THEN 'exclude' WHEN 'signup' THEN 'artefacto' END AS raw_class
FROM events"""


def slides(spark: SparkSession) -> DataFrame:
    return spark.range(SLIDES).select(F.col("id").alias("slide"), F.lit(SLIDE).alias("width"), F.lit(SLIDE).alias("height"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotations with ring: a concave pentagon of three quarters of the box."""
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    corners = [(F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")), (mid("x0", "x1"), mid("y0", "y1")), (F.col("x0"), F.col("y1"))]
    return annotations(spark, sf_dir).withColumn("ring", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey patches of the embeddings: vec_id, label, pixels (array of int, 0 to 255)."""
    pixel = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.6) / 1.2 * 255).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", pixel).alias("pixels"))


PATCH_SQL = """SELECT vec_id, label,
  list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.6e0) / 1.2e0 * 255))) AS INTEGER)) AS pixels
FROM embeddings"""


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """biopsy, doc_id (tile), truth, pred: labels matched to the documents' sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("biopsy"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("biopsy", "doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("pred"))


SEG_SQL = "SELECT d.source AS biopsy, l.doc_id, l.quality AS truth, l.toxic AS pred FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def biopsies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("biopsy")).filter("biopsy is not null").distinct()
