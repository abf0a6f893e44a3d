"""Fuzzy search for short license notices.

Each notice is a normalised phrase with an edit bound k. Split into k + 1 parts, at least one part is untouched by k
edits (pigeonhole), so exact occurrences of the parts (found by one Aho-Corasick pass) name all candidates. Around
each seed the regex library matches the whole phrase with bounded errors, the best match first and then what is left on
both of its sides, and matches are reported as spans of the document, with their edits. Texts are matched in normalised
form: words joined by single spaces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, id_text, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fuzzy notices and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the bsd 3 clause license": "bsd",
    "released under the bsd license": "bsd",
    "licensed under the bsd license": "bsd",
    "released under the isc license": "isc",
    "licensed under the isc license": "isc",
    "released under the gpl license": "gpl",
    "licensed under the gpl license": "gpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "reserved",
}
#: One edit is allowed for every EDIT_CHARS characters of a notice, three at most.
EDIT_CHARS = 10
MAX_EDITS = 3
#: Words that tell notices apart. A span has each of its notice's among its whole words: exactly, or from six letters on
#: within one edit.
TELLING = frozenset("mit bsd isc gpl apache 2 lesser affero general mozilla eclipse cc by nc sa nd commons attribution".split())


def edit_bound(phrase: str) -> int:
    return min(MAX_EDITS, len(phrase) // EDIT_CHARS)


def seeds(phrase: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts of nearly equal length with their offsets."""
    cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _one_edit(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion or substitution turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def _told(norm: str, start: int, end: int, telling: tuple[str, ...]) -> bool:
    """Whether the whole words under a span have the telling words of its notice."""
    while start < end and norm[start] == " ":
        start += 1
    while end > start and norm[end - 1] == " ":
        end -= 1
    stop = norm.find(" ", end)
    words = norm[norm.rfind(" ", 0, start) + 1 : stop if stop >= 0 else len(norm)].split()
    return all(t in words or (len(t) > 5 and any(_one_edit(t, w) for w in words)) for t in telling)


def _best(found: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int]]:
    """Of spans that overlap, the one whose notice has most characters less edits (twice counted) stays."""
    out: list[tuple[int, int, str, int]] = []
    group: list[tuple[int, int, str, int, int]] = []

    def close() -> None:
        taken: list[tuple[int, int, str, int]] = []
        for a, b, label, edits, _ in sorted(group, key=lambda x: (2 * x[3] - x[4], x)):
            if all(b <= c or d <= a for c, d, *_ in taken):
                taken.append((a, b, label, edits))
        out.extend(taken)
        group.clear()

    reach = 0
    for x in sorted(found):
        if x[0] >= reach:
            close()
        group.append(x)
        reach = max(reach, x[1])
    close()
    return sorted(set(out))


@lru_cache(maxsize=4)
def _index(notices: tuple[tuple[str, str], ...]):
    import ahocorasick
    import regex

    automaton, at = ahocorasick.Automaton(), {}
    compiled = []
    for n, (phrase, label) in enumerate(notices):
        k = edit_bound(phrase)
        compiled.append((regex.compile(rf"(?b)(?:{regex.escape(phrase)}){{e<={k}}}"), label, len(phrase), k, tuple(w for w in phrase.split() if w in TELLING)))
        for offset, part in seeds(phrase, k):
            at.setdefault(part, []).append((n, offset))
    for part, places in at.items():
        automaton.add_word(part, (len(part), places))
    automaton.make_automaton()
    return automaton, compiled


def matches(pattern, norm: str, a: int, b: int, shortest: int) -> Iterator:
    """Non-overlapping matches between a and b: the best of all, then those in what is left on either side of it."""
    open_ = [(a, b)]
    while open_:
        a, b = open_.pop()
        if b - a >= shortest and (m := pattern.search(norm, a, b)):
            yield m
            open_ += [(a, m.start()), (m.end(), b)]


def fuzzy(norm: str, notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items())) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of the notices in a normalised text, by start.

    Seeds whose windows overlap are searched together; a window's matches are tested for the notice's telling words, and
    of notices that overlap the best is reported.
    """
    automaton, compiled = _index(notices)
    zones: dict[int, list[list[int]]] = {}
    for end, (size, places) in automaton.iter(norm):
        for n, offset in places:
            _, _, length, k, _ = compiled[n]
            a = end + 1 - size - offset - k
            mine = zones.setdefault(n, [])
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], a + length + 2 * k)
            else:
                mine.append([a, a + length + 2 * k])
    found = []
    for n, mine in zones.items():
        pattern, label, length, k, telling = compiled[n]
        for a, b in mine:
            at, b = max(0, a), min(len(norm), b)
            if any(len(t) < 6 and norm.find(t, at, b) < 0 for t in telling):
                continue
            for m in matches(pattern, norm, at, b, length - k):
                if _told(norm, m.start(), m.end(), telling):
                    found.append((m.start(), m.end(), label, sum(m.fuzzy_counts), length))
    return _best(found)


def base_places(norm: str, phrases: dict[str, str] = BASE) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand consecutively, by index then label."""
    padded, out = f" {norm} ", []
    for phrase, label in phrases.items():
        at, seen, word = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, seen = word + padded.count(" ", seen, at), at
            out.append((word, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


def in_document(text: str, spans: list[tuple[int, int, str, int]]) -> list[dict]:
    """Spans of the normalised text as code points of the document (given in lower case), from first character to last."""
    starts, offsets, at = [], [], 0
    for m in WORD.finditer(text):
        starts.append(m.start())
        offsets.append(at)
        at += m.end() - m.start() + 1
    ends = [*offsets[1:], at]

    def place(x: int) -> int:
        i = bisect_right(offsets, x) - 1
        return starts[i] + min(x - offsets[i], ends[i] - offsets[i] - 1)

    return [{"start": place(a), "end": place(b - 1) + 1, "label": x, "edits": e} for a, b, x, e in spans]


_SCHEMA = (
    "n_words bigint, base array<struct<word:bigint,label:string>>, "
    "spans array<struct<start:bigint,end:bigint,label:string,edits:bigint>>, score double"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, base places, fuzzy spans, score) of every whole text; spans are code points of the text, end exclusive.

    score: 1 for a base place or an exact notice, else 1 - edits / length of the best span, 0 without any. Null or empty
    text: no words, nothing found. Empty table: no rows. Repeated rows get equal results; other columns are ignored.
    """
    wanted = tuple((NOTICES if notices is None else notices).items())

    def kernel(batch: pa.RecordBatch) -> list:
        counts, bases, spans, scores = [], [], [], []
        for text in batch.column("__text").to_pylist():
            text = text or ""
            text = text.lower() if text.isascii() else text.translate(LOWER)
            words = WORD.findall(text)
            norm = " ".join(words)
            base, found = base_places(norm), fuzzy(norm, wanted)
            counts.append(len(words))
            bases.append([{"word": w, "label": x} for w, x in base])
            spans.append(in_document(text, found) if found else [])
            scores.append(1.0 if base else max((1 - e / max(1, b - a) for a, b, _, e in found), default=0.0))
        return [counts, bases, spans, scores]

    return append(id_text(docs, id_col, text_col), kernel, _SCHEMA).drop("__text")


def op10(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    words, base = F.col("base.word"), F.col("base.label")

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.col("spans.label"))).alias("labels"),
        "score",
        "spans",
    )
