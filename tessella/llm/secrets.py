"""Secret scans on DataFrame functions alone: three patterns, and character Markov models for the rest.

Base kinds are patterns with a length rule. The method adds kind "markov": runs of MIN_RUN or more key characters
whose log-likelihood ratio between a bigram model of random strings and one of ordinary identifiers is over
THRESHOLD nats a character. The models are tables of bigram log-probabilities, one state for each key character, backed
off to the character's own frequency, so that a rare pair of letters is no proof of chance. They are trained from labelled
samples; the default samples are made by seeded rules below (a stated, bounded fit), and train() takes any others.
"""

from __future__ import annotations

import math
import random
import string
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "markov")
#: kind: (pattern, group whose length counts, least length)
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
MIN_RUN = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
THRESHOLD = 0.6
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
STATES = len(ALPHABET) + 1  # the last state is any other character of a sample
#: Bigrams that a character's own frequency counts for.
BACKOFF = 200.0
MASK = "[SECRET]"
#: Ordinary words of which the built-in identifiers are made.
WORDS = """account action address administration amount application article attribute authentication average balance
base begin block branch browser buffer build cache calculate callback cancel category channel check client collection
column command comment company component condition config connection container content context control controller
count country create currency customer data database date default delete delivery description destination detail
device dialog directory display document domain download driver duration element email enable error event exception
execute export factory feature field file filter folder format function gateway generation group handler header
height history image implementation index information initialize input instance integer interface internal invoice
item iterator label language layout length level library license limit list local location machine manager maximum
member message method minimum model module month name network node number object operation option order organization
output package page parameter parent password path payment percent performance permission person picture position
price primary process product profile project property provider public query question random range record reference
register release report repository request resource response result return schedule schema screen search section
select sequence server service session setting shipping signature size source standard start state status storage
string structure student subject summary support system table target template test thread time title token total
transaction transfer translation type update upload user utility validate value variable vector version view visible
warehouse website width window worker wrapper anderen arbeit entwicklung geschwindigkeit gesellschaft moeglichkeit
regierung unternehmen verantwortung versicherung wirtschaft wissenschaft zusammenarbeit agriculture changement
connaissance developpement environnement etablissement gouvernement responsabilite vraisemblablement administracion
caracteristicas conocimiento desarrollo establecimiento investigacion organizacion responsabilidad universidad""".split()


def samples(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """n labelled random strings (1) of several alphabets, and n ordinary strings (0): identifiers of several styles, rules of
    marks, and plain numbers and dates."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits)
    return [x for _ in range(n) for x in (("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), 1), (_ordinary(rng), 0))]


def _ordinary(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.04:  # a rule: one mark or a few in turn
        return "".join(rng.choices("=-_/+", k=rng.randint(1, 2))) * rng.randint(20, 40)
    if kind < 0.05:
        return rng.choice((string.ascii_lowercase, string.ascii_uppercase))
    if kind < 0.09:  # numbers, dates and counts up
        return rng.choice((str(rng.randrange(10**19, 10**22)), "1234567890" * 2, f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}/" * 2))
    words = rng.choices(WORDS, k=rng.randint(2, 6))
    style = rng.randrange(7)
    if style < 2:
        name = "".join(w.title() for w in words) if style else words[0] + "".join(w.title() for w in words[1:])
    else:
        name = ("", "_", "-", "/", "_")[style - 2].join(words)
    if rng.random() < 0.15:
        name = name.upper()
    if rng.random() < 0.3:
        name += rng.choice(("_v2", "-2024", "1", "_01", "/2023/11", "2"))
    return name


def _state(c: str) -> int:
    return ALPHABET.find(c) if c in ALPHABET else STATES - 1


@lru_cache(maxsize=8)
def train(labelled: tuple[tuple[str, int], ...] | None = None, backoff: float = BACKOFF) -> tuple[float, ...]:
    """Log-likelihood ratio (random over ordinary) of each bigram of states, row by row; by default of samples() and an
    ordinary run of each key character."""
    labelled = labelled or (*samples(), *((c * 100, 0) for c in ALPHABET))
    rows = []
    for label in (0, 1):
        pairs: Counter = Counter()
        for text, own in labelled:
            if own == label:
                s = [_state(c) for c in text]
                pairs.update(zip(s, s[1:], strict=False))
        count = [[pairs[(a, b)] for b in range(STATES)] for a in range(STATES)]
        total = sum(map(sum, count)) + STATES
        single = [(sum(row[b] for row in count) + 1) / total for b in range(STATES)]
        rows.append([[math.log((x + backoff * p) / (sum(row) + backoff)) for x, p in zip(row, single, strict=True)] for row in count])
    return tuple(r - o for random_, ordinary in zip(rows[1], rows[0], strict=True) for r, o in zip(random_, ordinary, strict=True))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(col: str, kind: str, pattern: str, group: int, least: int, test: str = "") -> Column:
    """Spans of a pattern's leftmost matches in code points, by the lengths of matches and of what lies between them.

    test: SQL on the match m, besides the length rule. Texts without a match are settled by one rlike.
    """
    p = _sql(pattern)
    parts = [f"split({col}, {p}, -1)", f"regexp_extract_all({col}, {p}, 0)", f"regexp_extract_all({col}, {p}, {group})"]
    names = "array<struct<gap:string,m:string,g:string>>"
    zipped = f"cast(arrays_zip({', '.join(parts)}) AS {names})"
    ok = f"length(x.g) >= {least}" + (f" AND {test}" if test else "")
    span = "named_struct('start', acc.at + length(x.gap), 'stop', acc.at + length(x.gap) + length(x.m))"
    kinds = "array<struct<start:int,stop:int>>"
    step = f"named_struct('at', acc.at + length(x.gap) + coalesce(length(x.m), 0), 'out', CASE WHEN {ok} THEN concat(acc.out, array({span})) ELSE acc.out END)"
    found = f"aggregate({zipped}, named_struct('at', 0, 'out', cast(array() AS {kinds})), (acc, x) -> {step}, acc -> acc.out)"
    guard = f"{col} rlike {_sql(pattern if kind != 'hex' else '[0-9a-f]{%d}' % least)}"
    return F.expr(f"CASE WHEN {guard} THEN {found} ELSE cast(array() AS {kinds}) END")


def _ratio(model: tuple[float, ...]) -> str:
    """SQL: mean log-likelihood ratio of x.m a character; linear in its length."""
    numbers = "cast(split('" + ",".join(f"{v:.4f}" for v in model) + "', ',') AS array<double>)"
    states = f"transform(split(x.m, ''), c -> coalesce(nullif(instr('{ALPHABET}', c), 0), {STATES}) - 1)"
    total = f"aggregate({states}, named_struct('s', 0D, 'p', -1), (a, c) -> named_struct('s', a.s + CASE WHEN a.p < 0 THEN 0D ELSE element_at({numbers}, a.p * {STATES} + c + 1) END, 'p', c), a -> a.s)"
    return f"({total} / (length(x.m) - 1))"


def scan(docs: DataFrame, text_col: str = "text", model: tuple[float, ...] | None = None, threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with an array column {prefix}{kind} of (start, stop) spans for each kind of KINDS.

    Null or empty text: empty arrays. Empty table: no rows. Code points from 0, stop exclusive. A markov span that lies whole
    in a base span is left out, as that span already covers it. Every row is scanned whole, however long, and on its own, so
    repeated rows get equal spans. A column of docs that has one of the new names is an error: choose another prefix.
    """
    text = f"__{prefix}tessella_scanned"
    taken = {text, *(prefix + k for k in KINDS)} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist; use another prefix")
    out = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    for kind, (pattern, group, least) in PATTERNS.items():
        out = out.withColumn(prefix + kind, _spans(text, kind, pattern, group, least))
    test = f"{_ratio(model or train())} > {threshold}D"
    out = out.withColumn(prefix + "markov", _spans(text, "markov", RUN, 0, MIN_RUN, test))
    base = f"concat({', '.join(prefix + k for k in PATTERNS)})"
    free = f"filter({prefix}markov, s -> NOT exists({base}, b -> b.start <= s.start AND s.stop <= b.stop))"
    return out.withColumn(prefix + "markov", F.expr(f"CASE WHEN size({prefix}markov) = 0 THEN {prefix}markov ELSE {free} END")).drop(text)


def joined(kinds: tuple[str, ...], prefix: str = "") -> str:
    """SQL: kind:start:end by start, then kind as listed, joined by commas."""
    each = ", ".join(f"transform({prefix}{k}, s -> named_struct('start', s.start, 'k', {KINDS.index(k)}, 'e', s.stop))" for k in kinds)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort(concat({each})), s -> concat(get({names}, s.k), ':', s.start, ':', s.e)), ',')"


def redact(docs: DataFrame, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every span of every kind in the text replaced by mask; overlapping spans become one."""
    p = "__tessella_"
    out = scan(docs.withColumn(p + "old", F.col(text_col)), p + "old", prefix=p)
    spans = f"array_sort(concat({', '.join(p + k for k in KINDS)}))"
    step = f"CASE WHEN s.start < acc.at THEN named_struct('at', greatest(acc.at, s.stop), 'out', acc.out) ELSE named_struct('at', s.stop, 'out', concat(acc.out, array(substring({p}old, acc.at + 1, s.start - acc.at), '{mask}'))) END"
    done = f"aggregate({spans}, named_struct('at', 0, 'out', cast(array() AS array<string>)), (acc, s) -> {step}, acc -> concat(array_join(acc.out, ''), substring({p}old, acc.at + 1, length({p}old))))"
    n = " + ".join(f"size({p}{k})" for k in KINDS)
    return out.withColumn(text_col, F.expr(f"CASE WHEN {n} = 0 THEN {p}old ELSE {done} END")).drop(p + "old", *(p + k for k in KINDS))


def op2(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text")), "__text")
    base = joined(tuple(PATTERNS))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.expr(base), 256).alias("base_sha256"),
        F.expr(joined(KINDS)).alias("spans"),
        F.size("markov").cast("bigint").alias("n_markov"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked, and n_chars follows the text where anything was masked."""
    out = redact(docs.withColumn("__tessella_before", F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.col("text") != F.col("__tessella_before")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__tessella_before")
