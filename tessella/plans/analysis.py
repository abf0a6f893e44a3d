"""Queries on sizes, classes, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bridge import ANN_SQL, SEG_SQL, annotations, biopsies, segmentation, table
from ..functions import scalars as s
from ..operators import metrics, splits, stats

SIZES_SQL = f"""ann AS ({ANN_SQL}), sz AS (SELECT slide, gid, raw_class, x1 - x0 AS width, y1 - y0 AS height, greatest(x1 - x0, y1 - y0) AS square_size, (x1 - x0) * (y1 - y0) AS area FROM ann)"""


def _sizes(spark, sf_dir):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return annotations(spark, sf_dir).select("slide", "gid", "raw_class", w.alias("width"), h.alias("height"), F.greatest(w, h).alias("square_size"), (w * h).alias("area"))


def _line_sizes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 50).alias("square_size"))


def size_stats(spark, sf_dir):
    columns = ["width", "height", "square_size", "area"]
    got = stats.spread(_sizes(spark, sf_dir), columns, ["raw_class"])
    return got.select("raw_class", "n", *[F.round(f"{k}_{c}", 4).alias(f"{k}_{c}") for c in columns for k in ("min", "max", "mean", "std")])


def _spread_sql(c: str) -> str:
    return ", ".join(f"round({f}({c}), 4) AS {n}_{c}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp")))


SIZE_STATS = f"WITH {SIZES_SQL} SELECT raw_class, count(*) AS n, {', '.join(map(_spread_sql, ('width', 'height', 'square_size', 'area')))} FROM sz GROUP BY raw_class"


def size_percentiles(spark, sf_dir):
    got = stats.percentiles(_line_sizes(spark, sf_dir), "square_size", ["l_returnflag"])
    return got.select("l_returnflag", "pct", F.round("value", 6).alias("value"))


PCT_SQL = """v AS (SELECT l_returnflag, l_extendedprice / 50 AS square_size FROM lineitem),
p AS (SELECT l_returnflag, unnest([50, 75, 85, 90, 95]) AS pct, unnest(quantile_cont(square_size, [0.5, 0.75, 0.85, 0.9, 0.95])) AS value FROM v GROUP BY l_returnflag)"""
SIZE_PERCENTILES = f"WITH {PCT_SQL} SELECT l_returnflag, pct, round(value, 6) AS value FROM p"


def tile_size_recommendation(spark, sf_dir):
    got = stats.recommendation(_line_sizes(spark, sf_dir), "square_size", ["l_returnflag"])
    return got.select("l_returnflag", "pct", "tile", "n", F.round("fit_pct", 6).alias("fit_pct"), "covered", "incomplete")


TILE_SIZE_RECOMMENDATION = f"""WITH {PCT_SQL}, t AS (SELECT *, CAST(least(2560, greatest(128, ceil(value / 128) * 128)) AS INTEGER) AS tile FROM p),
h AS (SELECT t.l_returnflag, pct, tile, count(*) AS n, count_if(square_size <= tile)::BIGINT AS fit FROM t JOIN v ON v.l_returnflag = t.l_returnflag GROUP BY ALL)
SELECT l_returnflag, pct, tile, n, round(fit * 100e0 / n, 6) AS fit_pct, CAST(ceil(n * pct / 100e0) AS BIGINT) AS covered, n - CAST(ceil(n * pct / 100e0) AS BIGINT) AS incomplete FROM h"""


def size_histogram(spark, sf_dir):
    return stats.histogram(_sizes(spark, sf_dir), "square_size", 0.0, 1000.0, 20)


SIZE_HISTOGRAM = f"WITH {SIZES_SQL} SELECT CAST(least(19, floor(square_size / 50)) AS INTEGER) AS bin, count(*) AS n FROM sz WHERE square_size BETWEEN 0 AND 1000 GROUP BY 1"


def size_trend(spark, sf_dir):
    return stats.trend(_sizes(spark, sf_dir), "width", "height", ["raw_class"]).select("raw_class", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


SIZE_TREND = f"WITH {SIZES_SQL} SELECT raw_class, round(regr_slope(height, width), 6) AS slope, round(regr_intercept(height, width), 6) AS intercept FROM sz GROUP BY raw_class"


def class_share(spark, sf_dir):
    a = annotations(spark, sf_dir).select(s.class_name(F.col("raw_class")).alias("class_name"))
    return stats.share(a, "class_name").select("class_name", "n", F.round("pct", 6).alias("pct"))


def _class_sql() -> str:
    from .tiling import CLASS_SQL

    return CLASS_SQL


CLASS_SHARE = f"WITH ann AS ({ANN_SQL}), c AS (SELECT {_class_sql()} AS class_name FROM ann) SELECT class_name, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct FROM c GROUP BY class_name"

BUCKETS = ("Proliferativo", "No_Proliferativo", "Esclerosado", "Excluyente")


def class_bucket_summary(spark, sf_dir):
    """Objects by slide and bucket, and their share of all."""
    a = annotations(spark, sf_dir)
    per = stats.class_counts(a, "slide", s.class_bucket(F.col("raw_class")), BUCKETS)
    whole = per.agg(F.sum("total").alias("__t"))
    return per.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col("total") * 100.0 / F.col("__t"), 6)).drop("__t")


CLASS_BUCKET_SUMMARY = f"""WITH ann AS ({ANN_SQL}), c AS (SELECT slide, lower(trim(raw_class)) AS c FROM ann),
b AS (SELECT slide, CASE WHEN contains(c, 'no') AND contains(c, 'prolif') THEN 'n' WHEN contains(c, 'proliferativo') THEN 'p' WHEN contains(c, 'esclerosado') THEN 'e' WHEN contains(c, 'exclude') THEN 'x' END AS b FROM c)
SELECT slide, count(*) AS total, count_if(b = 'p')::BIGINT AS proliferativo, count_if(b = 'n')::BIGINT AS no_proliferativo, count_if(b = 'e')::BIGINT AS esclerosado,
  count_if(b = 'x')::BIGINT AS excluyente, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY slide"""


def class_weights(spark, sf_dir):
    a = annotations(spark, sf_dir).select(s.class_name(F.col("raw_class")).alias("class_name"))
    return stats.class_weights(a, "class_name").select("class_name", "n", F.round("weight", 6).alias("weight"))


CLASS_WEIGHTS = f"WITH ann AS ({ANN_SQL}), c AS (SELECT {_class_sql()} AS class_name FROM ann) SELECT class_name, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM c GROUP BY class_name"


def native_to_tile(spark, sf_dir):
    """Sizes at the tile's zoom of one half."""
    z = _sizes(spark, sf_dir)
    return z.select("gid", s.to_tile_length(F.col("width"), 0.5).alias("width_tile"), s.to_tile_length(F.col("height"), 0.5).alias("height_tile"), s.to_tile_area(F.col("area"), 0.5).alias("area_tile"), s.recommended_tile(F.col("square_size")).alias("tile"))


NATIVE_TO_TILE = f"""WITH {SIZES_SQL} SELECT gid, round(width * 0.5e0, 2) AS width_tile, round(height * 0.5e0, 2) AS height_tile, round(area * 0.25e0, 2) AS area_tile,
  CAST(least(2560, greatest(128, ceil(square_size / 128) * 128)) AS INTEGER) AS tile FROM sz"""


def group_split(spark, sf_dir):
    return splits.hash_split(biopsies(spark, sf_dir), "biopsy")


SPLIT_SQL = """b AS (SELECT DISTINCT source AS biopsy FROM documents WHERE source IS NOT NULL),
r AS (SELECT biopsy, (row_number() OVER (ORDER BY md5(biopsy || '|42'), biopsy) - 1) / CAST(count(*) OVER () AS DOUBLE) AS pos FROM b),
sp AS (SELECT biopsy, CASE WHEN pos < 0.7e0 THEN 'train' WHEN pos < 0.7e0 + 0.15e0 THEN 'val' ELSE 'test' END AS split FROM r)"""
GROUP_SPLIT = f"WITH {SPLIT_SQL} SELECT * FROM sp"


def group_split_permutation(spark, sf_dir):
    return splits.permutation_frame(spark, biopsies(spark, sf_dir), "biopsy")


def split_semi_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("biopsy"), "n_chars")
    kept = splits.rows_of_split(docs, group_split(spark, sf_dir), "biopsy", "test")
    return kept.groupBy("biopsy").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


SPLIT_SEMI_JOIN = f"WITH {SPLIT_SQL} SELECT source AS biopsy, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source IN (SELECT biopsy FROM sp WHERE split = 'test') GROUP BY source"


def split_resume_anti(spark, sf_dir):
    """Biopsies that a resumed run has left, the first five by name: the limit is the run's own setting."""
    done = group_split(spark, sf_dir).filter("split = 'train'").select("biopsy")
    return splits.not_done(biopsies(spark, sf_dir), done, "biopsy", 5)


SPLIT_RESUME_ANTI = f"WITH {SPLIT_SQL} SELECT biopsy FROM b WHERE biopsy NOT IN (SELECT biopsy FROM sp WHERE split = 'train') ORDER BY biopsy LIMIT 5"


def split_validation(spark, sf_dir):
    return splits.overlaps(group_split(spark, sf_dir), "biopsy").withColumn("shared", F.col("shared").cast("bigint"))


SPLIT_VALIDATION = "SELECT * FROM (VALUES ('train_val', 0::BIGINT), ('train_test', 0::BIGINT), ('val_test', 0::BIGINT)) v(pair, shared)"


def shared_biopsies(spark, sf_dir):
    """Biopsies that two datasets (two languages) both have."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "biopsy")
    return splits.shared_groups(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), "biopsy")


SHARED_BIOPSIES = "SELECT source AS biopsy FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'"


def _tile_scores(spark, sf_dir):
    seg = segmentation(spark, sf_dir).withColumn("tile", F.col("doc_id") % 7)
    return metrics.binary_scores(seg, ["biopsy", "tile"])


def seg_metrics_tile(spark, sf_dir):
    return _tile_scores(spark, sf_dir).select("biopsy", "tile", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in metrics.SCORES])


SCORES_SQL = f"""seg AS ({SEG_SQL}), c AS (SELECT biopsy, doc_id % 7 AS tile, count_if(truth > 0 AND pred > 0)::BIGINT AS tp, count_if(NOT truth > 0 AND pred > 0)::BIGINT AS fp, count_if(truth > 0 AND NOT pred > 0)::BIGINT AS fn
  FROM seg GROUP BY 1, 2),
sc AS (SELECT biopsy, tile, tp, fp, fn, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)"""
ROUNDED = ", ".join(f'round("{c}", 6) AS "{c}"' for c in metrics.SCORES)
SEG_METRICS_TILE = f"WITH {SCORES_SQL} SELECT biopsy, tile, tp, fp, fn, {ROUNDED} FROM sc"


def seg_metrics_macro(spark, sf_dir):
    per = metrics.macro(_tile_scores(spark, sf_dir), ["biopsy"])
    return metrics.across(per).select(*[F.round(f"{k}_{c}", 6).alias(f"{k}_{c}") for c in metrics.SCORES for k in ("mean", "std")])


SEG_METRICS_MACRO = f"""WITH {SCORES_SQL}, m AS (SELECT biopsy, {", ".join(f'avg("{c}") AS "{c}"' for c in metrics.SCORES)} FROM sc GROUP BY biopsy)
SELECT {", ".join(f'round(avg("{c}"), 6) AS mean_{c}, round(stddev_samp("{c}"), 6) AS std_{c}' for c in metrics.SCORES)} FROM m"""


def mean_iou(spark, sf_dir):
    return metrics.mean_iou(segmentation(spark, sf_dir)).select("cls", "inter", "uni", F.round("iou", 6).alias("iou"))


MEAN_IOU = f"""WITH seg AS ({SEG_SQL}), k AS (SELECT DISTINCT unnest([truth, pred]) AS cls FROM seg)
SELECT cls, count_if(truth = cls AND pred = cls)::BIGINT AS inter, count_if(truth = cls OR pred = cls)::BIGINT AS uni,
  round(count_if(truth = cls AND pred = cls) / CAST(count_if(truth = cls OR pred = cls) AS DOUBLE), 6) AS iou FROM seg, k GROUP BY cls"""

PIVOT = ("No_Proliferativo", "Proliferativo", "Esclerosado", "Excluido")


def class_pivot(spark, sf_dir):
    a = annotations(spark, sf_dir).select("slide", s.class_name(F.col("raw_class")).alias("class_name"))
    return metrics.class_pivot(a, "slide", "class_name", PIVOT)


CLASS_PIVOT = f"""WITH ann AS ({ANN_SQL}), c AS (SELECT slide, {_class_sql()} AS c FROM ann)
SELECT slide, {", ".join(f"count_if(c = '{v}')::BIGINT AS {v}" for v in PIVOT)}, count_if(c IN ('No_Proliferativo', 'Proliferativo', 'Esclerosado', 'Excluido'))::BIGINT AS total FROM c GROUP BY slide"""


def production_totals(spark, sf_dir):
    got = metrics.production_totals(segmentation(spark, sf_dir).withColumn("tile", F.concat_ws("/", "biopsy", F.col("doc_id") % 7)), "biopsy", "tile")
    return got.withColumn("per_group", F.round("per_group", 6))


PRODUCTION_TOTALS = f"WITH seg AS ({SEG_SQL}) SELECT count(DISTINCT biopsy) AS groups, count(DISTINCT biopsy || '/' || (doc_id % 7)) AS tiles, count(*) AS objects, round(count(*) / CAST(count(DISTINCT biopsy) AS DOUBLE), 6) AS per_group FROM seg"


def softmax_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("logits"))
    p = e.select("vec_id", s.softmax(F.col("logits")).alias("p"), F.col("logits"))
    return p.select("vec_id", s.argmax(F.col("logits")).alias("class_id"), F.round(F.array_max("p"), 6).alias("confidence"), (s.sigmoid(F.get("logits", F.lit(0)).cast("double")) > 0.5).alias("positive"))


SOFTMAX_ARGMAX = """WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings),
x AS (SELECT vec_id, l, list_max(l) AS m, list_sum(list_transform(l, lambda v: exp(v))) AS z FROM l)
SELECT vec_id, CAST(list_position(l, m) - 1 AS INTEGER) AS class_id, round(exp(m) / z, 6) AS confidence, 1 / (1 + exp(-l[1])) > 0.5e0 AS positive FROM x"""


def slide_formats(spark, sf_dir):
    """Reader of a file by extension and size, over paths made from the pages' ids; the pages' bytes, times a factor, are the size."""
    p = table(spark, sf_dir, "pages")
    ext = F.get(F.array(*map(F.lit, ("tif", "TIFF", "svs", "ndpi", "png", "jpeg", "txt"))), (F.col("page_id") % 7).cast("int"))
    named = p.select(F.concat(F.lit("slides/s"), "page_id", F.lit("."), ext).alias("path"), (F.octet_length("html").cast("bigint") * 60000).alias("length"))
    return named.groupBy(s.slide_format(F.col("path"), F.col("length")).alias("format")).agg(F.count("*").alias("n"), F.round(F.sum(s.memory_gb(F.col("length"))), 6).alias("memory_gb"))


SLIDE_FORMATS = """WITH p AS (SELECT page_id % 7 AS e, CAST(octet_length(encode(html)) AS BIGINT) * 60000 AS length FROM pages)
SELECT CASE WHEN e IN (0, 1) THEN CASE WHEN length > 314572800 THEN 'openslide' ELSE 'pil' END WHEN e IN (2, 3) THEN 'openslide' WHEN e IN (4, 5) THEN 'pil' END AS format,
  count(*) AS n, round(sum(length / 1073741824e0 * 5), 6) AS memory_gb FROM p GROUP BY 1"""

QUERIES = {
    "size_stats": (size_stats, SIZE_STATS),
    "size_percentiles": (size_percentiles, SIZE_PERCENTILES),
    "tile_size_recommendation": (tile_size_recommendation, TILE_SIZE_RECOMMENDATION),
    "size_histogram": (size_histogram, SIZE_HISTOGRAM),
    "size_trend": (size_trend, SIZE_TREND),
    "class_share": (class_share, CLASS_SHARE),
    "class_bucket_summary": (class_bucket_summary, CLASS_BUCKET_SUMMARY),
    "class_weights": (class_weights, CLASS_WEIGHTS),
    "native_to_tile": (native_to_tile, NATIVE_TO_TILE),
    "group_split": (group_split, GROUP_SPLIT),
    "group_split_permutation": (group_split_permutation, None),
    "split_semi_join": (split_semi_join, SPLIT_SEMI_JOIN),
    "split_resume_anti": (split_resume_anti, SPLIT_RESUME_ANTI),
    "split_validation": (split_validation, SPLIT_VALIDATION),
    "shared_biopsies": (shared_biopsies, SHARED_BIOPSIES),
    "seg_metrics_tile": (seg_metrics_tile, SEG_METRICS_TILE),
    "seg_metrics_macro": (seg_metrics_macro, SEG_METRICS_MACRO),
    "mean_iou": (mean_iou, MEAN_IOU),
    "class_pivot": (class_pivot, CLASS_PIVOT),
    "production_totals": (production_totals, PRODUCTION_TOTALS),
    "softmax_argmax": (softmax_argmax, SOFTMAX_ARGMAX),
    "slide_formats": (slide_formats, SLIDE_FORMATS),
}
