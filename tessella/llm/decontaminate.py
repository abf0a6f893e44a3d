"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions alone.

A window (WINDOW consecutive words of an item; a shorter item is one window) is the set of its SHINGLE-word shingles
with their offsets. A document holds a window only if it holds all of them, so the necessary prefix is one shingle:
the window's rarest, by its count over all documents. Documents are joined on that shingle alone; the positional
bound puts the window's start at the hit minus the shingle's offset, the length bound keeps it inside the document,
and the window's words are then compared with the document's there. Windows whose rarest shingle is in no document
take no part.

Documents are only scanned; what is shuffled are the matches. The benchmark side is broadcast while it has at most
BROADCAST_WINDOWS windows of BROADCAST_BYTES in all, a checked bound; beyond, the join is on (shingle) by shuffle, of the
positions that pass a bitmap of the benchmark's shingles, and only candidates go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, if_small, table

WINDOW = 10
SHINGLE = 5
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Bits of the bitmap of shingles (16 MB), and of one of its rows, which is what Spark's bitmap functions hold.
BITMAP, ROW = 1 << 27, 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(col: str) -> Column:
    """Words of a text with A-Z (and no other letter) lower-cased; null has none."""
    text = F.coalesce(F.col(col), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _key(array: str, at: Column, k: int) -> Column:
    """Hash of the k words from position at."""
    return F.xxhash64(F.lit(k), *[F.get(F.col(array), at + i) for i in range(k)])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, w, wid): the windows of each item; wid is the window's words in one string. Rows without words have none."""
    items = benchmark.select(F.col(id_col).alias("item"), words(text_col).alias("ws")).filter("size(ws) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0)))
    cut = items.select("item", "ws", F.explode(starts).alias("s")).select("item", F.slice("ws", F.col("s") + 1, F.lit(size)).alias("w"))
    return cut.withColumn("wid", F.array_join("w", " ")).distinct()


def _shingles(wins: DataFrame, k: int) -> DataFrame:
    """(w, wid, off, key) for the windows whose shingles have k words."""
    mine = wins.filter(F.least(F.size("w"), F.lit(SHINGLE)) == k)
    return mine.select("w", "wid", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("off")).withColumn("key", _key("w", F.col("off"), k))


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """docs (with array ws) for each position that starts k words, with the hash of those words."""
    each = docs.select("*", F.posexplode("ws").alias("pos", "__word"))
    return each.drop("__word").filter(F.col("pos") <= F.size("ws") - k).withColumn("key", _key("ws", F.col("pos"), k))


def _inside(n: Column) -> Column:
    """Positional and length bounds of a candidate."""
    return (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("m") <= n)


def _by_broadcast(docs: DataFrame, prefix: DataFrame, own: list[str], k: int) -> DataFrame:
    """Candidates are verified where they are found, beside the document's words."""
    at = F.col("pos") - F.col("off")
    exact = reduce(lambda c, i: c & ((F.lit(i) >= F.col("m")) | (F.get("ws", at + i) == F.get("w", F.lit(i)))), range(WINDOW), F.lit(True))
    found = _positions(docs, k).join(F.broadcast(prefix), "key").filter(_inside(F.size("ws")) & exact)
    return found.select(*own, at.alias("start"), "m", "wid")


def _of_bitmap(positions: DataFrame, keys: DataFrame) -> DataFrame:
    """The positions whose key may be one of keys: its place in a bitmap of fixed size, which is broadcast, is set."""
    place = F.pmod(F.col("key"), F.lit(BITMAP))
    at = (place % ROW).cast("int")
    bitmap = keys.select((place / ROW).cast("int").alias("__row"), (place % ROW).alias("at")).groupBy("__row").agg(F.bitmap_construct_agg("at").alias("__bits"))
    told = positions.withColumn("__row", (place / ROW).cast("int")).withColumn("__at", at).join(F.broadcast(cut_lineage(bitmap)), "__row")
    byte = F.ascii(F.decode(F.expr("substring(__bits, __at div 8 + 1, 1)"), "ISO-8859-1"))
    return told.filter(byte.bitwiseAND(F.expr("shiftleft(1, __at % 8)")) != 0).drop("__row", "__at", "__bits")


def _by_shuffle(docs: DataFrame, prefix: DataFrame, own: list[str], k: int) -> DataFrame:
    """For benchmarks too large to broadcast: positions are shuffled as hashes without any words, candidates go back to
    their document once, and only the words under a candidate are compared with the window's."""
    slim = _of_bitmap(_positions(docs, k).select(*own, "pos", F.size("ws").alias("n"), "key"), prefix)
    found = slim.join(prefix.select("key", "wid", "off", "m"), "key").filter(_inside(F.col("n")))
    per = found.groupBy(*own).agg(F.collect_set(F.struct((F.col("pos") - F.col("off")).alias("start"), "m", "wid")).alias("c"))
    per = per.select(*[F.col(c).alias(f"__{c}") for c in own], "c")
    same = reduce(lambda x, y: x & y, [docs[c].eqNullSafe(per[f"__{c}"]) for c in own])
    told = docs.join(per, same).select(*own, "ws", F.explode("c").alias("c")).select(*own, "c.start", "c.m", "c.wid", F.slice("ws", F.col("c.start") + 1, F.col("c.m")).alias("got"))
    return told.join(prefix.select("wid", "w"), "wid").filter("got = w").select(*own, "start", "m", "wid")


def matches(docs: DataFrame, wins: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs' columns (ws but for) with start, m and wid for every place where a window's words stand in ws."""
    wins = cut_lineage(wins.select("w", "wid").distinct())
    count, size = wins.agg(F.count("*"), F.sum(F.octet_length("wid"))).first()
    kinds = [r[0] for r in wins.select(F.least(F.size("w"), F.lit(SHINGLE))).distinct().collect()]
    small, out = count <= broadcast_windows and (size or 0) <= BROADCAST_BYTES, []
    own = [c for c in docs.columns if c != "ws"]
    for k in sorted(kinds):
        grams = _shingles(wins, k)
        wanted = grams.select("key").distinct()
        keys = _positions(docs.select("ws"), k).select("key")
        freq = (keys.join(F.broadcast(wanted), "key") if small else _of_bitmap(keys, wanted).join(wanted, "key")).groupBy("key").agg(F.count("*").alias("n"))
        ranked = grams.join(cut_lineage(freq), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        first = ranked.groupBy("wid").agg(F.min_by(F.struct("w", "off", "key", "n"), F.struct("n", "off")).alias("p"))
        prefix = cut_lineage(first.filter("p.n > 0").select("wid", "p.w", "p.off", "p.key").withColumn("m", F.size("w")))
        out.append((_by_broadcast if small else _by_shuffle)(docs, prefix, own, k))
    return reduce(DataFrame.unionByName, out) if out else docs.drop("ws").limit(0).selectExpr("*", "0 AS start", "0 AS m", "'' AS wid")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, digest, n_hit, items) for documents with a hit; digest (a hash of the text) tells rows that share an id apart.

    Repeated rows are one row here and match each of themselves when joined back. A null id of a document is an id of its own.
    Items without an id hit words like any other, but can't be listed. No item, no document, or none with words: no rows.
    Whole texts are read, however long.
    """
    wins = cut_lineage(windows(benchmark, item_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), words(text_col).alias("ws"))
    places = matches(keyed, wins, broadcast_windows)
    named = places.join(wins.select("wid", "item"), "wid")
    per = named.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "m")).alias("spans"), F.collect_set(F.col("item").cast("string")).alias("items"))
    step = "named_struct('upto', greatest(a.upto, s.start + s.m), 'n', a.n + greatest(0, s.start + s.m - greatest(a.upto, s.start)))"
    covered = F.expr(f"aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0), (a, s) -> {step}, a -> cast(a.n AS bigint))")
    return per.select("id", "digest", covered.alias("n_hit"), F.array_sort("items").alias("items"))


def op9(spark, sf_dir: str) -> DataFrame:
    """n_words, n_hit and items of every document; null and empty texts have no words and are clean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut_lineage(hits(docs, table(spark, sf_dir, "benchmark")))
    base = docs.select("doc_id", F.xxhash64("text").alias("d"), F.size(words("text")).cast("bigint").alias("n_words"))
    both = base.join(found, base["doc_id"].eqNullSafe(found["id"]) & (base["d"] == found["digest"]), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return both.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of the benchmark occurs go."""
    found = cut_lineage(hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))).select(F.col("id").alias("__tessella_id"), F.col("digest").alias("__tessella_d"))
    same = docs["doc_id"].eqNullSafe(found["__tessella_id"]) & (F.xxhash64(docs["text"]) == found["__tessella_d"])
    return docs.join(if_small(found), same, "left_anti")
