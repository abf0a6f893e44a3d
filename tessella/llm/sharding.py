"""Proportional stratified interleaving into equal shards.

Within each source rows are put in a seeded random order; a row's fractional rank is (rank + 0.5) / rows of the
source. Sorted by it, any stretch of rows holds each source in proportion, so the shards cut from the order match the
mixture, and their counts differ by one at most (law "rows").

No source is ever sorted in one task: the seeded hash is cut into ranges (buckets). A table of counts by (source,
bucket) gives each bucket's first rank, and a row adds its place inside the bucket. Fractional ranks are turned into
positions likewise. So the order does not depend on the number of buckets. The running sums over buckets are windows of
rows / 20,000 short rows. Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, cut_lineage, table

SHARDS = 40
OVERHEAD = 16
SEED = 17
#: Bits of the seeded hash, of the first digits of an MD5.
HASH_BITS = 60


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """rows with their place (from 0) within group, in order of (bucket, order); a bucket is the most that is sorted together."""
    sizes = rows.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group or [F.lit(0)]).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select(*group, bucket, F.coalesce(before, F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    return rows.withColumn("__place", place).join(first, [*group, bucket]).withColumn(out, F.col("__first") + F.col("__place")).drop("__first", "__place")


def interleave(rows: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows (columns id, source, size, crc; n in all) with position (from 0), shard and slot.

    A null source is a source of its own. Ties of the seeded hash (repeated rows) go by id, checksum and size. Empty
    input gives no rows. Fewer rows than shards leave shards empty between them.
    """
    buckets = buckets_for(n)
    mixed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "crc", "size")), 1, HASH_BITS // 4), 16, 10).cast("bigint")
    keyed = rows.withColumn("source", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))).withColumn("__h", mixed).withColumn("__b", F.floor(F.col("__h") / 2.0**HASH_BITS * buckets))
    ranked = _ranked(keyed, ["source"], "__b", ["__h", "id", "crc", "size"], "__rank")
    totals = keyed.groupBy("source").agg(F.count("*").alias("__total"))
    shared = ranked.join(totals, "source").withColumn("__f", (F.col("__rank") + 0.5) / F.col("__total"))
    shared = cut_lineage(shared.withColumn("__fb", F.floor(F.col("__f") * buckets)).select("id", "source", "size", "crc", "__f", "__fb", "__h"))
    placed = _ranked(shared, [], "__fb", ["__f", "source", "__h", "id", "crc", "size"], "position")
    cut = placed.select("id", "size", "crc", "position").withColumn("shard", F.expr(f"cast(position * {shards}L div {max(n, 1)}L as int)"))
    return cut.withColumn("slot", F.expr(f"position - (shard * {n}L + {shards - 1}L) div {shards}L"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: id, size (UTF-8 bytes and OVERHEAD; null text: none), checksum, shard and slot.

    Null ids and texts are placed like any others; extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    slim = cut_lineage(slim)
    return interleave(slim, slim.count(), shards, seed)


def op5(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
