"""Packing into windows of 2048 tokens by non-negative least squares over length combinations.

A document's ids are cut from its start into whole windows and a rest, so pieces depend on the document alone and are
tokenised once. The plan is made from the histogram of piece lengths (at most WINDOW bins, whatever the corpus):
shallow combinations of lengths that fill a window exactly are enumerated, their repeat counts are solved against the
histogram by non-negative least squares and rounded: down first, then up in order of the fractions as far as pieces are
left, so that the solution's combinations, which fill their windows, take most of the pieces. The residual is packed
greedily, largest length first, each hole taking the largest length that fits. A plan is a list of runs (length, first rank, count, first sequence, offset):
its size depends on the bins, not on the rows.

Rows find their place by rank: the k-th piece of its length takes the k-th place the plan holds for that length. Ranks
come from counts by (length, hash bucket) and the place inside a bucket, so a length that a third of all rows share is
spread over many tasks.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append, buckets_for, cut_lineage, id_text, table

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(ranks: str | None = None):
    """text -> ids of the byte-level BPE; the ranks file holds the same vocabulary as VOCABULARY (tested against it).

    The added tokens of VOCABULARY have their own ids wherever their strings stand in a text, as in the tokenizers
    library, for whose ids tiktoken takes about a seventh of the CPU time.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(ranks or vocabulary_path(RANKS), "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary_path(VOCABULARY), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    own = {x: i for x, i in added.items() if merges.get(x.encode()) != i}
    return partial(tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in merges.items() if v not in own.values()}, special_tokens=own).encode, allowed_special="all")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ranks: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): whole windows from the start and the rest of each document.

    Null text: empty, so one piece of END_ID alone. Repeated rows give repeated pieces. Empty table: no rows. Whole texts
    are cut, however long; other columns are ignored.
    """

    def kernel(batch: pa.RecordBatch) -> list:
        encode, out = encoder(ranks), []
        for text in batch.column("__text").to_pylist():
            ids = array("I", encode(text or ""))
            ids.append(END_ID)
            raw, n = ids.tobytes(), len(ids)
            out.append([{"start": s, "length": min(window, n - s), "ids_crc32": crc32(raw[4 * s : 4 * (s + window)]), "doc_tokens": n} for s in range(0, n, window)])
        return [out]

    cut = append(id_text(docs, id_col, text_col), kernel, "__pieces array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>")
    return cut.select(id_col, F.inline("__pieces"))


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of up to four present lengths that sum to the window: all pairs, and for each length x the repeats
    (x, x, r), (x, x, x, r) and x with the pairs that halve or quarter what it leaves."""
    window = len(histogram) - 1
    here = [int(x) for x in np.flatnonzero(histogram) if x]
    found = {(window,)} | {tuple(sorted((x, window - x))) for x in here if x < window}
    for x in here:
        rest = window - x
        found |= {tuple(sorted((x, x, rest - x))), tuple(sorted((x, x, x, rest - 2 * x)))}
        found |= {tuple(sorted((x, y, rest - y))) for d in range(-8, 9) for y in (rest // 2 + d, rest // 4 + d, rest // 8 + d)}
    return sorted(c for c in found if min(c) > 0 and all(histogram[x] for x in c))


def solve(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares |A x - h|, A[length, pattern] = uses, by accelerated projected gradients."""
    if not patterns:
        return np.zeros(0)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    h = histogram.astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[col], minlength=len(h))

    def backward(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, r[row], minlength=len(patterns))

    v = np.ones(len(patterns))
    for _ in range(20):
        v = backward(forward(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - backward(forward(y) - h) / (1.05 * size))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram (index: length) exactly: solved ones first, then greedy ones."""
    solved, left = solution(histogram)
    return solved + greedy(left)


def solution(histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The rounded least-squares solution, and the histogram of the pieces it leaves."""
    window, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    left[0] = 0
    steps: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        steps.append(((window,), int(left[window])))
        left[window] = 0
    patterns = combinations(left)
    counts = solve(patterns, left)
    whole = np.floor(counts + 1e-6).astype(np.int64)
    for wanted, order in ((whole, np.argsort(-whole, kind="stable")), ((counts - whole > 1e-3).astype(np.int64), np.argsort(whole - counts, kind="stable"))):
        for i in order[wanted[order] > 0]:
            uses = Counter(patterns[i])
            repeats = min([int(wanted[i]), *(int(left[x]) // n for x, n in uses.items())])
            if repeats > 0:
                steps.append((patterns[i], repeats))
                for x, n in uses.items():
                    left[x] -= n * repeats
    return steps, left


def greedy(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram: the largest length first, each hole taking the largest that fits."""
    window, left = len(histogram) - 1, histogram.copy()
    steps: list[tuple[tuple[int, ...], int]] = []
    # Greedy: each step uses up at least one bin's whole repeats, so there are at most a few steps for each length.
    present = [int(x) for x in np.flatnonzero(left)]
    while present:
        hole, chosen = window, []
        for x in reversed(present):
            fit = min(hole // x, int(left[x]))
            chosen += [x] * fit
            hole -= fit * x
        uses = Counter(chosen)
        repeats = min(int(left[x]) // n for x, n in uses.items())
        steps.append((tuple(chosen), repeats))
        for x, n in uses.items():
            left[x] -= n * repeats
        present = [x for x in present if left[x]]
    return steps


def runs(steps: list[tuple[tuple[int, ...], int]], window: int) -> np.ndarray:
    """Rows (length * BASE + first rank, first sequence, offset) sorted by the first column."""
    used, sequence, out = defaultdict(int), 0, []
    for combination, repeats in steps:
        offset = 0
        for x in combination:
            out.append((x, used[x], sequence, offset))
            used[x] += repeats
            offset += x
        sequence += repeats
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (with column length) with sequence_id and offset. Empty input: no rows.

    Pieces of one length are alike to the plan; which takes which place is settled by a hash of the row.
    """
    names = cut.columns
    cut = cut_lineage(cut.withColumn("__h", F.xxhash64(*names)))
    buckets = buckets_for(cut.count())
    cut = cut.withColumn("__b", F.pmod("__h", F.lit(buckets)))
    sizes = cut_lineage(cut.groupBy("length", "__b").agg(F.count("*").alias("__n")))
    histogram = np.zeros(window + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("__n")).collect():
        histogram[length] = n
    layout = runs(plan(histogram), window)
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("length", "__b", F.coalesce(before, F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("length", "__b").orderBy("__h", *names)) - 1
    ranked = cut.withColumn("__place", place).join(first, ["length", "__b"]).withColumn("__rank", F.col("__first") + F.col("__place"))

    def kernel(batch: pa.RecordBatch) -> list:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
        at = np.empty(len(lengths), np.int64)
        for x in np.unique(lengths):
            lo, hi = np.searchsorted(layout[:, 0], [x, x + 1])
            mine = lengths == x
            at[mine] = lo + np.searchsorted(layout[lo:hi, 1], ranks[mine], side="right") - 1
        return [pa.array(layout[at, 2] + ranks - layout[at, 1]), pa.array(layout[at, 3])]

    return append(ranked.select(*names, "__rank"), kernel, "sequence_id bigint, offset bigint").select(*names, "sequence_id", "offset")


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document kept so far is packed; the last stage's rows are pieces."""
    return pack(pieces(docs))
