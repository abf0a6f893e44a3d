"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits differ in at most two
bytes, so at least MATCHES = 6 positional bytes agree. The index posts each distinct fingerprint under the bytes of
a few position sets of KEY_BYTES positions each; the sets are such that any six positions contain one of them whole,
so every linked pair meets in some posting list. Within a list the shared positional bytes of each pair are tallied,
pairs under six are dropped, and the rest are verified by the bits of their XOR.

A posting list of more than HOT fingerprints is not paired. Its members agree in the key's bytes, so they link
exactly if their other 24 bits have a common point within one bit of both: each member is posted under its own
free bits and their 24 one-bit neighbours, and linked to the least member of each such point. That is exact and
linear, so no list size is capped.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, cut_estimates, cut_lineage, id_text, if_small, join_keyed, table

MAX_BITS = 2
MATCHES = 6
KEY_BYTES = 5
HOT = 128
SEED = 42
#: Near copies of the pipeline's stage: shingle words, least Jaccard similarity, bands of minimum hashes, the agreeing
#: positional bytes a candidate needs (a pair of similarity 0.8 has 64 on average, under 44 with probability 1e-7).
COPY_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
AGREE = 44
#: Members of a list that are compared in one piece of work, members from which a list meets pivots first, and pivots.
BLOCK = 512
HOT_LIST = 8192
PIVOTS = 3
_LANES = np.uint64(0x0101010101010101)
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)


def position_sets(key_bytes: int = KEY_BYTES, differing: int = 2) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any pair of differing positions is outside one of them (greedy cover)."""
    open_pairs, sets = set(combinations(range(8), differing)), []
    while open_pairs:
        best = max(combinations(range(8), 8 - key_bytes), key=lambda out: sum(p in open_pairs for p in combinations(out, differing)))
        open_pairs -= set(combinations(best, differing))
        sets.append(tuple(i for i in range(8) if i not in best))
    return sets


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles in order; fewer words than a shingle has are one shingle. No word: none."""
    if len(words) < shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: a bit is one if it is set in over half of the shingle hashes. No word: zero."""
    return _bits(_hashes((text or "").encode().lower().split(), shingle))


def _bits(h: np.ndarray) -> int:
    if not len(h):
        return 0
    # Eight 8-bit lanes at a time: a block of 255 hashes can't overflow a lane.
    blocks, out = np.arange(0, len(h), 255), 0
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & _LANES, blocks).view(np.uint8).reshape(-1, 8)
        ones = lanes.sum(axis=0, dtype=np.int64) * 2 > len(h)
        for byte in np.flatnonzero(ones).tolist():
            out |= 1 << (8 * byte + shift)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint zero."""

    def kernel(batch: pa.RecordBatch) -> list:
        values = np.array([fingerprint(t, shingle) for t in batch.column("__text").to_pylist()], np.uint64)
        return [pa.array(values.view(np.int64))]

    return append(id_text(docs, id_col, text_col), kernel, "fp bigint").drop("__text")


def _byte(col, position: int):
    return F.shiftrightunsigned(col, 8 * position).bitwiseAND(F.lit(0xFF))


def _mask(positions) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): edges whose connected components are those of "differs in at most MAX_BITS bits" on distinct fp."""
    sets = position_sets()
    fp = F.col("fp")
    posts = fps.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(_mask(s))) for s in sets])).alias("pset", "bytes"))
    shared = posts.groupBy("pset", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    live = cut_lineage(posts.join(shared, ["pset", "bytes"]))
    cold = live.filter(F.col("n") <= hot)
    x = cold.select("pset", "bytes", F.col("fp").alias("a"))
    y = cold.select("pset", "bytes", F.col("fp").alias("b"))
    tally = reduce(lambda s, p: s + (_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int"), range(8), F.lit(0))
    paired = (
        x.join(y, ["pset", "bytes"])
        .filter((F.col("a") < F.col("b")) & (tally >= MATCHES))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    return paired.unionByName(_hot_links(live.filter(F.col("n") > hot), sets)).distinct()


def _hot_links(live: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """Stars through shared points one bit away at most: linear in the members of a large posting list."""
    free = [[8 * p + b for p in range(8) if p not in s for b in range(8)] for s in sets]
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint") for b in bits]) for bits in free])
    points = live.select("pset", "fp", F.explode(flips[F.col("pset")]).alias("flip")).select("pset", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("pset", "point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").drop("z")
    return points.join(least, ["pset", "point"]).filter("a < fp").select("a", F.col("fp").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star rounds, root the least node.

    Each round is two joins by key; no node's neighbours are ever gathered in a row. Results are checkpointed, also those of
    the aggregates, so that both sides of each join are plain exchanges and AQE can split a hub's edges. Estimated sizes are
    not carried on: the joins of the rounds would multiply them on the driver without bound.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    now, before = cut_estimates(now), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            return now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")).unionByName(
                now.select(F.least("u", "v").alias("node"), F.least("u", "v").alias("root")).distinct()
            )
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_estimates(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = cut_estimates(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        floor = cut_estimates(small.groupBy("u").agg(F.min("v").alias("m")))
        linked = small.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = cut_estimates(linked.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hot: int = HOT) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the least id reachable through links, itself included.

    Equal fingerprints collapse before anything is paired, so groups of copies cost one fingerprint. Null or empty
    text: fingerprint zero, linked like any other. Repeated rows each get a row. A null id gets the component's least
    non-null id (null if there is none). Empty table: no rows. Other columns are ignored, whatever their names.
    """
    fps = cut_lineage(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__id", "__t", shingle))
    found = components(links(fps.select("fp").distinct(), hot))
    return _named(fps, found, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def _groups(rows: DataFrame, found: DataFrame, key: str, least) -> DataFrame:
    """(key, n, least) for the keys that several rows have or that found (node, root) links: n rows have the key, and least
    is the minimum of the column least over all rows of the key's component. Lineage is cut."""
    reps = rows.groupBy(key).agg(F.min(least).alias("rep"), F.count("*").alias("n"))
    rooted = reps.join(found.select(F.col("node").alias(key), "root"), key, "left").filter("n > 1 OR root IS NOT NULL")
    rooted = cut_lineage(rooted.withColumn("root", F.coalesce("root", key)))
    roots = cut_lineage(rooted.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("__n")))
    return cut_lineage(join_keyed(rooted, roots, "root", "__n").select(key, "n", "least"))


def _named(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows (__id, key, ...) with component_id, the least id of the component that found (node, root) gives their key."""
    groups = _groups(rows, found, key, F.col("__id")).withColumnRenamed("least", "__least")
    return join_keyed(rows, groups, key, "n").withColumn("component_id", F.when(F.col("n").isNull(), F.col("__id")).otherwise(F.col("__least")))


def signature(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minimum hashes of a set of shingle hashes."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(out, (hashes[i : i + 512, None] * _FACTORS + _TERMS).min(axis=0), out=out)
    return out


def _sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    return [np.unique(_hashes((t or "").encode().lower().split(), shingle)) for t in texts]


def _banded(docs: DataFrame, shingle: int) -> DataFrame:
    """(__id, key, fp, bands): a digest of the text, its SimHash fingerprint and the codes of its bands."""

    def kernel(batch: pa.RecordBatch) -> list:
        fps, bands = [], []
        for text in batch.column("__t").to_pylist():
            hashes = _hashes((text or "").encode().lower().split(), shingle)
            fps.append(_bits(hashes))
            raw = signature(np.unique(hashes)).tobytes()
            bands.append([xxhash.xxh64_intdigest(raw[i : i + 8 * ROWS], i) - (1 << 63) for i in range(0, len(raw), 8 * ROWS)])
        return [pa.array(np.array(fps, np.uint64).view(np.int64)), bands]

    return append(docs, kernel, "fp bigint, bands array<bigint>").drop("__t")


def _band_posts(texts: DataFrame) -> DataFrame:
    """(key, band, code): the lists of minimum hashes."""
    return texts.select("key", F.posexplode("bands").alias("band", "code"))


def _linked_posts(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, band, code): a list, with band -1, for each component of fingerprints that links() connects; the texts of one
    fingerprint meet there too."""
    fps = cut_lineage(texts.select("key", "fp"))
    found = components(links(fps.select("fp").distinct(), hot)).select(F.col("node").alias("fp"), "root")
    rooted = join_keyed(fps, cut_lineage(fps.groupBy("fp").agg(F.count("*").alias("__n")).join(found, "fp", "left").filter("__n > 1 OR root IS NOT NULL")), "fp", "__n")
    rooted = rooted.filter("__n IS NOT NULL")
    return rooted.select("key", F.lit(-1).alias("band"), F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("code"))


def _facts(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, sig, hashes): the positional bytes, one of each minimum hash, and the sorted shingle set in 32-bit hashes."""

    def kernel(batch: pa.RecordBatch) -> list:
        sets = _sets(batch.column("__t").to_pylist(), shingle)
        sigs = [(signature(h) >> np.uint64(48)).astype(np.uint8).tobytes() for h in sets]
        return [sigs, [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in sets]]

    return append(texts, kernel, "sig binary, hashes binary").drop("__t")


def alike(keys: list, sigs: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, labels: np.ndarray, band: int, kind: str) -> list[tuple]:
    """Links (key, key) that span the near copies among the members of one piece of work.

    A pair counts in the first band that it shares, and in a list of linked fingerprints. kind "all" compares all members, "cross" those of unlike sides, "pivot"
    those of side 1 with the others. Pairs of one label are known to be connected. A pair needs sizes within SIMILARITY, then
    AGREE common positional bytes, then SIMILARITY of its sets; of the links found, those that connect two parts stay.
    """
    n, parent, out = len(keys), list(range(len(keys))), []
    size = np.array([len(x) for x in sets])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        if kind == "pivot":
            if not sides[i]:
                continue
            others = np.flatnonzero(sides == 0)
        else:
            others = np.arange(i + 1, n)
            if kind == "cross":
                others = others[sides[others] != sides[i]]
        others = others[(labels[others] != labels[i]) & (np.minimum(size[others], size[i]) >= SIMILARITY * np.maximum(size[others], size[i]))]
        same = sigs[others] == sigs[i]
        enough = same.sum(axis=1) >= AGREE
        others, same = others[enough], same[enough]
        # A pair of a list of linked fingerprints (band -1) counts there in any case.
        first = np.full(len(others), True) if band < 0 else same.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        mine = root(i)
        others = [j for j in others[first].tolist() if root(j) != mine and keys[j] != keys[i]]
        if not others:
            continue
        if size[i]:
            every, starts = np.concatenate([sets[j] for j in others]), np.concatenate([[0], np.cumsum(size[others])[:-1]])
            at = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), starts)
            near = both >= SIMILARITY * (size[others] + size[i] - both)
        else:
            near = np.ones(len(others), bool)
        for j, ok in zip(others, near.tolist(), strict=True):
            if ok and root(j) != root(i):
                parent[root(j)] = root(i)
                out.append((keys[i], keys[j]))
    return out


def _meet(work: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b): links found in the pieces of work (code, i, j; rows band, key, side, c). A piece's size is bounded by BLOCK, so
    rows are sorted by piece and read as a stream; j is -1 where side 1 are pivots."""
    rows = work.join(facts.hint("merge"), "key").select("code", "i", "j", "band", "key", "side", "c", "sig", "hashes")
    rows = rows.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j")

    def pieces(batches):
        held, mine = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != mine:
                    if len(held) > 1:
                        yield held
                    held, mine = [], row[:3]
                held.append(row)
        if len(held) > 1:
            yield held

    def kernel(batches):
        found: list[tuple] = []
        for rows in pieces(batches):
            _, i, j, band, *_ = rows[0]
            keys, sides, labels, sigs, sets = zip(*(r[4:] for r in rows), strict=True)
            kind = "pivot" if j < 0 else "all" if i == j else "cross"
            matrix = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(rows), -1)
            found += alike(keys, matrix, [np.frombuffer(x, np.uint32) for x in sets], np.array(sides), np.array(labels), band, kind)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    return cut_lineage(rows.mapInArrow(kernel, "u bigint, v bigint").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())


def _work(lists: DataFrame) -> DataFrame:
    """Pieces of work for lists (code, band, key, c, big, n_rest, n_big): members are dealt into blocks, and each pair of blocks is
    a piece, but for pairs of blocks of big, whose members are of one component."""
    rest, big = (F.ceil(F.col(c) / BLOCK) for c in ("n_rest", "n_big"))
    deal = F.xxhash64(F.lit("block"), "key")
    own = F.when(F.col("big"), rest + F.pmod(deal, F.greatest(big, F.lit(1)))).otherwise(F.pmod(deal, F.greatest(rest, F.lit(1))))
    many = lists.filter("n_rest > 0").withColumn("side", own)
    met = F.sequence(F.lit(0), F.when(F.col("big"), rest - 1).otherwise(rest + big - 1))
    many = many.withColumn("other", F.explode(met))
    return many.select("code", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "band", "key", "side", "c")


def _hot_lists(hot: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of large lists to PIVOTS of their members each, and the lists with the largest component so found told apart.

    Linear in the members. A list of one component alone needs no more work.
    """
    chunks = F.ceil(F.col("n") / BLOCK)
    chosen = F.array_distinct(F.array(*[F.min_by("key", F.xxhash64(F.lit(k), "key")) for k in range(PIVOTS)]))
    pivots = hot.groupBy("code").agg(chosen.alias("keys"), F.first("band").alias("band"), F.first("n").alias("n"))
    pivots = pivots.select("code", "band", "n", F.explode("keys").alias("key")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("i"))
    members = hot.select("code", "band", "key", F.pmod(F.xxhash64(F.lit("block"), "key"), chunks).alias("i"), F.lit(0).alias("side"))
    work = members.unionByName(pivots.select("code", "band", "key", "i", F.lit(1).alias("side")))
    near = _meet(work.withColumn("j", F.lit(-1).cast("bigint")).withColumn("c", F.col("key")), facts)
    roots = cut_lineage(components(near).groupBy("node").agg(F.min("root").alias("root")))
    told = cut_lineage(hot.drop("c").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("c", F.coalesce("root", "key")).drop("root"))
    sizes = told.groupBy("code", "c").agg(F.count("*").alias("m")).groupBy("code").agg(F.max(F.struct("m", "c")).alias("top"))
    told = told.join(sizes.hint("merge"), "code").withColumn("n_big", F.when(F.col("top.m") > 1, F.col("top.m")).otherwise(F.lit(0).cast("bigint")))
    return near, told.withColumn("big", (F.col("n_big") > 0) & (F.col("c") == F.col("top.c"))).withColumn("n_rest", F.col("n") - F.col("n_big")).drop("top")


def _copies(texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """For rows (__id, __t): (__id, key) with key a hash of the text, and the components (node, root) of linked keys."""
    texts = texts.withColumn("key", F.xxhash64(F.coalesce("__t", F.lit(""))))
    made = cut_lineage(_banded(texts, shingle))
    distinct = made.select("key", "fp", "bands").dropDuplicates(["key"])
    posts = _linked_posts(distinct).unionByName(_band_posts(distinct))
    shared = posts.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1")
    live = cut_lineage(posts.join(shared.hint("merge"), "code"))
    # One row of each text: copies don't meet in a task.
    one = made.groupBy("key").agg(F.min("__id").alias("least")).join(live.select("key").distinct(), "key", "left_semi")
    one = if_small(cut_lineage(one.withColumnRenamed("key", "mine")))
    some = texts.join(one, (F.col("key") == F.col("mine")) & F.col("__id").eqNullSafe(F.col("least")), "left_semi")
    facts = cut_lineage(_facts(some.select("key", "__t").dropDuplicates(["key"]), shingle))
    live = live.withColumn("c", F.col("key"))
    lists, near = live.filter(F.col("n") <= HOT_LIST).select("*", F.lit(False).alias("big"), F.col("n").alias("n_rest"), F.lit(0).cast("bigint").alias("n_big")), []
    if not live.filter(F.col("n") > HOT_LIST).isEmpty():
        linked, hot = _hot_lists(live.filter(F.col("n") > HOT_LIST), facts)
        lists, near = lists.unionByName(hot), [linked]
    links = reduce(DataFrame.unionByName, near, _meet(_work(lists), facts))
    return made.select("__id", "key"), cut_lineage(components(links))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE) -> DataFrame:
    """(id, key, component_id) for every row: components of "Jaccard similarity of shingle sets is at least SIMILARITY".

    Texts whose SimHash fingerprints are connected by links() (byte-position index, tally, verification by bits) meet first.
    The pairs beyond its MAX_BITS, which are most at this similarity, meet by a longer fingerprint: one byte of each of
    BANDS * ROWS minimum hashes of the text's shingles, in an index of position sets of ROWS minimum hashes; all their shared positional bytes are tallied, pairs with AGREE or more are kept and
    verified by their whole shingle sets. So no pair below the bound is linked, and a pair of similarity 0.8 shares no
    position set with probability 3e-5. Equal texts collapse before anything is paired.

    Lists are dealt into blocks of BLOCK members, and pairs of blocks are compared where they lie; only links that connect
    parts leave them, so that what is shuffled is members, not pairs. Lists of over HOT_LIST members are compared with
    PIVOTS of them first, which is linear; members of the largest component so found are not compared with one another
    again. Nothing is capped.

    Null and empty texts are equal and form one group. Repeated rows each get a row. Texts are told apart by a 64-bit hash.
    """
    rows, found = _copies(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), shingle)
    return _named(rows, found, "key").select(F.col("__id").alias(id_col), "key", "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the least id, nulls last.

    Decisions are by row, that is by (id, hash of the text): unrelated texts under one id are told apart, and rows without
    an id are deduplicated like others. Of rows with equal id and text, the one whose JSON is least stays. Empty table: no
    rows. Only ids and hashes are joined back; texts are shuffled for repeated rows alone, or if over a million rows go.
    """
    rows, found = _copies(docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__t")), COPY_SHINGLE)
    first = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("key").alias("text"))
    groups = _groups(rows, found, "key", first)
    pairs = rows.groupBy("__id", "key").agg(F.count("*").alias("__copies"))
    told = join_keyed(pairs, groups, "key", "n").filter("least IS NOT NULL").withColumn("stays", F.col("__id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.text")))
    told = cut_lineage(told.filter("NOT stays OR __copies > 1").select(F.col("__id").alias("__tessella_id"), F.col("key").alias("__tessella_key"), "stays"))
    same = docs["doc_id"].eqNullSafe(F.col("__tessella_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__tessella_key"))
    kept = docs.join(if_small(told.drop("stays")), same, "left_anti")
    again = docs.join(if_small(told.filter("stays").drop("stays")), same)
    names = [again[c] for c in docs.columns]
    least = again.groupBy("__tessella_id", "__tessella_key").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("__tessella_row"))
    return kept.unionByName(least.select("__tessella_row.*"))
