"""Image files and tile folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import biopsy_of_path, parse_tile_name, slide_format

IMAGES = "*.{png,jpg,jpeg,tif,tiff}"


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, stem, length, format): files of a folder without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "length", slide_format(F.col("path"), F.col("length")).alias("format"))


def pixels(spark: SparkSession, folder: str, pattern: str = IMAGES) -> DataFrame:
    """(path, height, width, channels, data): decoded images; data is row by row in BGR order. Broken files are dropped."""
    return spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder).select("image.*").withColumnRenamed("origin", "path").withColumnRenamed("nChannels", "channels")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """metadata.json of cases, with 1.0 for a missing downsample ratio."""
    schema = "tile_size int, overlap int, zoom_scale double, native_width int, native_height int, downsample_ratio double, format string, glomerulus_count int, has_annotations boolean"
    files = spark.read.json(folder, schema=schema, multiLine=True, pathGlobFilter="metadata.json", recursiveFileLookup=True)
    return files.withColumn("case", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).withColumn("downsample_ratio", F.coalesce("downsample_ratio", F.lit(1.0)))


def tiles(files: DataFrame) -> DataFrame:
    """Files whose name is a tile's, with its place, in reading order (y, x); masks and others are left out."""
    named = files.withColumn("__t", parse_tile_name(F.col("stem"))).filter(F.col("__t").isNotNull() & ~F.col("stem").endswith("_mask"))
    return named.select("path", F.col("__t.stem").alias("slide"), F.col("__t.x").alias("x0"), F.col("__t.y").alias("y0"), F.col("__t.endx").alias("x1"), F.col("__t.endy").alias("y1")).orderBy("y0", "x0")


def tiles_by_biopsy(files: DataFrame, folder: str) -> DataFrame:
    """(biopsy, paths): image tiles below a data folder by biopsy; masks are no tiles."""
    inside = F.regexp_replace("path", rf"^.*?{folder.rstrip('/')}/", "")
    kept = files.filter(~F.col("path").contains("/masks/") & ~F.col("stem").endswith("_mask")).withColumn("biopsy", biopsy_of_path(inside))
    return kept.groupBy("biopsy").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def complete_biopsies(files: DataFrame, folder: str) -> DataFrame:
    """Biopsies that have both image and mask files."""
    parts = files.withColumn("__p", F.split(F.regexp_replace("path", rf"^.*?{folder.rstrip('/')}/", ""), "/"))
    kinds = parts.groupBy(F.get("__p", F.lit(0)).alias("biopsy")).agg(F.count_if(F.get("__p", F.lit(1)) == "images").alias("images"), F.count_if(F.get("__p", F.lit(1)) == "masks").alias("masks"))
    return kinds.filter("images > 0 AND masks > 0")


def info(decoded: DataFrame, mpp: float = 0.5) -> DataFrame:
    """(path, width, height, mpp): plain images carry no resolution, so mpp is the default."""
    return decoded.select("path", "width", "height", F.lit(mpp).alias("mpp"))


def of_formats(files: DataFrame, allowed: tuple[str, ...] | None) -> DataFrame:
    """Files of the allowed extensions; None allows all."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files if allowed is None else files.filter(ext.isin(*(a.lower() for a in allowed)))
