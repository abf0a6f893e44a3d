"""Nearest-centroid language identification over normalised TF-IDF character n-gram vectors.

Vectors: hashed byte bigrams and trigrams of the lower-cased UTF-8 text, in which each run of ASCII characters that are
no letters is one space; counts are log-scaled, weighted by IDF, and the vector has length one.
Each language has up to CLUSTERS centroids (spherical k-means). A text takes the language of the centroid with the
largest cosine. Rejection is by distance: short texts have lower cosines, so each band of n-gram counts has its own floor,
FLOOR times the LOWEST quantile of the cosines that the sample's texts reach when their n-grams are thinned to that band.
Under it a text is like no learned language.

Bound: the classifier is fitted on about PER_LANG texts of each of the MAX_LANGS most frequent languages, fewer if that is
over MAX_SAMPLE in all, chosen by a hash of the id (a stated sample of labelled rows; whole texts). Prediction covers
every row and never sees lang, source or the id.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, table

DIMS = 4096
PER_LANG = 400
CLUSTERS = 4
MAX_LANGS = 1000
MAX_SAMPLE = 8000
#: Texts that set the floors, the quantile of their cosines, and the share of it that is still accepted.
CALIBRATION = 400
LOWEST = 0.01
FLOOR = 0.36
UNKNOWN = "und"
_SLICE = 128
#: Code of each byte: itself for a-z and bytes of other letters, a space for the rest of ASCII.
_LETTERS = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def ngram_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of hashed bigram and trigram counts, one for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = _LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)]
        space = b == 32
        b = b[~(space & np.concatenate([[False], space[:-1]]))]
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 263 + b[2:]
        for codes, salt in ((two, 17), (three, 40503)):
            row += np.bincount(((codes + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _band(counts: np.ndarray) -> np.ndarray:
    """The band of a text by its number of n-grams: short texts have lower cosines."""
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int)


@dataclass
class Centroids:
    langs: list[str]
    idf: np.ndarray
    owner: np.ndarray  # index into langs of each centroid
    matrix: np.ndarray  # centroids x DIMS
    floors: np.ndarray  # least accepted cosine by band

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine and whether the distance rejects it."""
        cos = self.vectors(counts) @ self.matrix.T
        best = cos.argmax(axis=1)
        top = np.clip(cos[np.arange(len(cos)), best], 0, 1)
        return self.owner[best], top, top < self.floors[np.minimum(_band(counts), len(self.floors) - 1)]


def _kmeans(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        near = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(len(centres))]))
    return centres


def fit_counts(counts: np.ndarray, labels: list[str], clusters: int = CLUSTERS) -> Centroids | None:
    """Centroids from n-gram counts and their labels; None if there are none."""
    if not labels:
        return None
    langs = sorted(set(labels))
    mine = np.array([langs.index(x) for x in labels])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(counts) * idf)
    parts = [_kmeans(x[mine == i], clusters) for i in range(len(langs))]
    model = Centroids(langs, idf, np.repeat(np.arange(len(langs)), [len(p) for p in parts]), np.concatenate(parts), np.zeros(1))
    model.floors = _floors(model, counts)
    return model


def _floors(model: Centroids, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Least accepted cosine by band, from texts thinned to each band's n-grams (Poisson draws); from the longest band that the
    sample reaches on, the floor stays the same."""
    rng = np.random.default_rng(seed)
    some = counts[rng.permutation(len(counts))[:CALIBRATION]]
    total = np.maximum(some.sum(axis=1), 1)
    floors, row, col = [], *np.nonzero(some)
    for band in range(41):
        enough = total >= 1.5 * 2**band
        if enough.sum() < min(20, len(total)):
            break
        thin = np.zeros_like(some)
        thin[row, col] = rng.poisson(some[row, col] * (1.5 * 2**band / total)[row])
        best = (model.vectors(thin[enough]) @ model.matrix.T).max(axis=1)
        floors.append(FLOOR * max(0.0, float(np.quantile(best, LOWEST))))
    return np.array(floors or [0.0])


def _lowered(column: pa.Array) -> list[bytes]:
    return pc.utf8_lower(pc.fill_null(column, "")).cast(pa.binary()).to_pylist()


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, clusters: int = CLUSTERS) -> Centroids | None:
    """Fit on about per_lang rows of each non-null language, chosen by a hash of the id; texts stay on the executors. None if
    no row has a language and a text."""
    ids = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text")).filter("__lang is not null and __text is not null")
    sizes = ids.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(MAX_LANGS).collect()
    if not sizes:
        return None
    per_lang = min(per_lang, MAX_SAMPLE / len(sizes))
    shares = F.create_map(*chain.from_iterable((F.lit(r[0]), F.lit(min(1.0, per_lang / r[1]))) for r in sizes))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "__id"), F.lit(1_000_000)) / 1e6
    sample = ids.filter(draw < shares[F.col("__lang")]).select("__lang", "__text")

    def kernel(batch: pa.RecordBatch) -> list:
        out = []
        for row in ngram_counts(_lowered(batch.column("__text"))):
            hit = np.flatnonzero(row)
            out.append(hit.astype("<u2").tobytes() + row[hit].astype("<f4").tobytes())
        return [out]

    got = sorted(tuple(r) for r in append(sample, kernel, "__vec binary").select("__lang", "__vec").collect())
    counts = np.zeros((len(got), DIMS), np.float32)
    for row, (_, raw) in zip(counts, got, strict=True):
        n = len(raw) // 6
        row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return fit_counts(counts, [r[0] for r in got], clusters)


def identify(docs: DataFrame, model: Centroids | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (cosine) and rejected, for every row (column names start with prefix).

    Null, empty or letterless text, or no model: lang_pred "und", score 0, rejected. Equal cosines: the first centroid
    in order of language. Empty table: no rows. Whole texts are read, however long; a row depends on nothing but its text.
    A column of docs that has one of the new names is an error: choose another prefix.
    """

    def kernel(batch: pa.RecordBatch) -> list:
        text = batch.column(text_col)
        letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if model is None:
            return [[UNKNOWN] * len(text), [0.0] * len(text), [True] * len(text)]
        lowered = _lowered(text)
        parts = [model.predict(ngram_counts(lowered[i : i + _SLICE])) for i in range(0, len(lowered), _SLICE)]
        lang, top, far = (np.concatenate(p) for p in zip(*parts, strict=True))
        names = [model.langs[i] if ok else UNKNOWN for i, ok in zip(lang.tolist(), letters, strict=True)]
        return [names, pa.array(np.where(letters, top, 0.0).astype(np.float64)), pa.array(far | ~letters)]

    taken = {prefix + c for c in ("lang_pred", "score", "rejected")} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist; use another prefix")
    return append(docs, kernel, f"{prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learn(docs: DataFrame) -> Centroids | None:
    return fit(docs.select("doc_id", "lang", "text").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), _learn(docs))
    return out.drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay, and lang becomes the language found; those that the distance rejects, or
    without a letter, go."""
    out = identify(docs, _learn(docs), prefix="__tessella_").filter("not __tessella_rejected")
    return out.select(*[F.col("__tessella_lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])
