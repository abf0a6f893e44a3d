"""Queries and SQL of this subpackage for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, html_extract, langid, licenses, media, packing, secrets, sharding, simhash, token_counts


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": token_counts.op1,
    "op2_secret_scan": secrets.op2,
    "op3_language_id": langid.op3,
    "op4_simhash_dedup": simhash.op4,
    "op5_sharding": sharding.op5,
    "op6_media_columns": media.op6,
    "op7_packing": packing.op7,
    "op8_html_extraction": html_extract.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_license_scan": licenses.op10,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, ws[s : s + {decontaminate.WINDOW - 1}] AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {decontaminate.WINDOW}, 0) + 2)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(w) AS n FROM w),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
p AS (SELECT r, n, i, ws[i : i + n - 1] AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT p.r, p.i, p.n, w.item_id FROM p JOIN w ON w.w = p.w),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(x) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, coalesce(t.ids, sha256('')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r"""

OP5 = f"""WITH RECURSIVE steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS v FROM steps WHERE k = 8),
b AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
s AS (SELECT doc_id, src, len(bytes) + {sharding.OVERHEAD} AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c // 256, crcs.v[(xor(c, x) % 256) + 1])), 4294967295) AS crc FROM b, crcs),
h AS (SELECT *, CAST('0x' || substr(md5('{sharding.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || crc || '|' || size), 1, {sharding.HASH_BITS // 4}) AS BIGINT) AS h FROM s),
r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, crc, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY src) AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, src, h, doc_id NULLS FIRST, crc, size) - 1 AS place, count(*) OVER () AS n FROM r),
c AS (SELECT *, place * {sharding.SHARDS} // n AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(place - (shard * n + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c"""


def _either_case(pattern: str) -> str:
    """A pattern that leads with (?i), with both cases of its ASCII letters and of no other letter."""
    names, rest = pattern.removeprefix("(?i)").split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in names) + ")" + rest


def _op2() -> str:
    patterns = {k: (_either_case(p) if p.startswith("(?i)") else p, g, n) for k, (p, g, n) in secrets.PATTERNS.items()}
    patterns["markov"] = (secrets.RUN, 0, secrets.MIN_RUN)
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [
        f"SELECT r, t, {i} AS k, {least} AS least, string_split_regex(t, {quote(p)}) AS gaps, regexp_extract_all(t, {quote(p)}) AS ms, regexp_extract_all(t, {quote(p)}, {g}) AS gs FROM d"
        for i, (p, g, least) in enumerate(patterns.values())
    ]
    base = len(secrets.PATTERNS)
    state = lambda c: f"CASE WHEN strpos('{secrets.ALPHABET}', {c}) > 0 THEN strpos('{secrets.ALPHABET}', {c}) ELSE {secrets.STATES} END"
    model = ",".join(f"{v:.4f}" for v in secrets.train())
    line = "coalesce(string_agg(['assign', 'access', 'hex', 'markov'][k + 1] || ':' || a || ':' || z, ',' ORDER BY a, k, z){}, '')"
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(patterns))
    return f"""WITH model AS (SELECT CAST([{model}] AS DOUBLE[]) AS v),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
u AS (SELECT r, k, least, unnest(gaps) AS gap, unnest(ms) AS m, unnest(gs) AS g, unnest(range(1, len(gaps) + 1)) AS i FROM f),
s AS (SELECT r, k, least, m, g, CAST(sum(len(gap) + coalesce(len(m), 0)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS z FROM u),
w AS (SELECT r, k, m, z - len(m) AS a, z FROM s WHERE m IS NOT NULL AND len(g) >= least),
x AS (SELECT w.r, w.k, w.a, w.z FROM w, model WHERE k < {base} OR list_sum(list_transform(range(1, len(m)), lambda i: v[(({state("m[i]")}) - 1) * {secrets.STATES} + ({state("m[i + 1]")})])) / (len(m) - 1) > {secrets.THRESHOLD}),
y AS (SELECT * FROM x WHERE k < {base} OR NOT EXISTS (SELECT 1 FROM x b WHERE b.r = x.r AND b.k < {base} AND b.a <= x.a AND x.z <= b.z)),
n AS (SELECT r, {counts}, {line.format(f" FILTER (k < {base})")} AS base, {line.format("")} AS spans FROM y GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_markov, 0) AS n_markov FROM d LEFT JOIN n ON n.r = d.r"""


#: SQL for the driver's comparison, where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {"op2_secret_scan": _op2(), "op5_sharding": OP5, "op9_decontamination": OP9}
