"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

Pre-tokens are the white-space separated words, each led by a word mark. The distinct new pre-tokens of a stretch of
texts are inserted in a trie of characters; a node holds the best log-probability and token count of segmenting its
prefix, computed once from its ancestors however many pre-tokens share the prefix, and the terminal counts are kept.
A text's count is the sum of its pre-tokens' terminal counts.

The pieces are a public vocabulary; its log-probabilities follow Zipf's law on the pieces' order: -log(rank + 2). A
character outside the vocabulary costs one byte piece for each of its UTF-8 bytes. Of equal scores the fewer tokens win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append, id_text, table
from .packing import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Terminal counts a worker keeps before it starts anew (memory bound; counts don't depend on it).
MAX_TERMINALS = 600_000
#: Words of one trie, and characters of text that are counted together.
CHUNK = 50_000
SLICE = 2_000_000
#: Pre-tokens from this length on are segmented by the same scores on their own and their counts aren't kept: the rows of a trie
#: are as wide as its longest word, and so the kept ones are bounded in bytes too.
MAX_KEPT = 200


@lru_cache(maxsize=2)
def pieces(path: str | None = None) -> tuple[dict[str, float], int, float]:
    """Scores of the pieces, the longest piece's characters, and the score of a byte piece (under any other's)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path(VOCABULARY))
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = -math.log(len(scores) + 2)
    return scores, max(map(len, scores)), -math.log(len(scores) + 2)


def segment(word: str, scores: dict[str, float], longest: int, byte_score: float) -> int:
    """Tokens of the best segmentation of one pre-token, by forward scores over all its prefixes."""
    best, counts = [0.0], [0]
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode("utf-8", "surrogatepass"))
        top, tokens = best[-1] + n * byte_score, counts[-1] + n
        for i in range(max(0, d - longest), d):
            score = scores.get(word[i:d])
            if score is not None:
                s, c = best[i] + score, counts[i] + 1
                if s > top or (s == top and c < tokens):
                    top, tokens = s, c
        best.append(top)
        counts.append(tokens)
    return counts[-1]


class Pieces:
    """The pieces as a trie of their reversed characters: steps holds (state, character + 1) in order, after the next
    state, score the log-probability of the piece that ends in a state (minus infinity if none does)."""

    def __init__(self, path: str | None = None):
        self.scores, self.longest, self.byte_score = pieces(path)
        child: dict[tuple[int, int], int] = {}
        score = [-math.inf]
        for piece, value in self.scores.items():
            state = 0
            for c in reversed(piece):
                state = child.setdefault((state, ord(c) + 1), len(score))
                if state == len(score):
                    score.append(-math.inf)
            score[state] = value
        keys = np.array([s << 21 | c for s, c in child], np.int64)
        order = np.argsort(keys)
        self.steps, self.after = keys[order], np.array(list(child.values()), np.int64)[order]
        self.score = np.array(score)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states; -1 where no piece goes on."""
        key = state << 21 | char
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        return np.where(self.steps[at] == key, self.after[at], -1)


def trie_counts(words: list[str], vocabulary: Pieces) -> list[int]:
    """Tokens of each of the distinct words (led by the mark, MAX_KEPT characters at most), over one trie of them all.

    Sorted words make the trie: a row starts a node of depth d if its first d characters differ from the row above.
    Depth by depth, the forward scores of all nodes are computed from their ancestors', each node once: going back from
    a node, the reversed piece trie says which starts are pieces and when none can follow.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    lengths = np.array([len(words[i]) for i in order])
    width = int(lengths.max())
    chars = np.array([words[i] for i in order], f"<U{width}").view(np.uint32).reshape(-1, width).astype(np.int64)
    chars = np.where(np.arange(width) < lengths[:, None], chars + 1, 0)  # a null character isn't padding
    rows = np.arange(len(order))
    # By depth: the row of each row's node, and at those rows the forward score and tokens.
    node = [np.zeros(len(order), np.int64)]
    best, tokens = [np.zeros(len(order))], [np.zeros(len(order), np.int64)]
    fresh = rows == 0
    result = np.zeros(len(order), np.int64)
    for d in range(1, width + 1):
        c = chars[:, d - 1]
        fresh = fresh | np.concatenate([[True], c[1:] != c[:-1]])
        node.append(np.maximum.accumulate(np.where(fresh, rows, 0)))
        at = np.flatnonzero(fresh & (lengths >= d))
        size = 1 + (c[at] > 0x80) + (c[at] > 0x800) + (c[at] > 0x10000)
        parent = node[d - 1][at]
        top, count = best[d - 1][parent] + size * vocabulary.byte_score, tokens[d - 1][parent] + size
        live, state = np.arange(len(at)), np.zeros(len(at), np.int64)
        for back in range(1, min(d, vocabulary.longest) + 1):
            state = vocabulary.step(state, chars[at[live], d - back])
            going = state >= 0
            live, state = live[going], state[going]
            if not len(live):
                break
            start = node[d - back][at[live]]
            s, k = best[d - back][start] + vocabulary.score[state], tokens[d - back][start] + 1
            better = (s > top[live]) | ((s == top[live]) & (k < count[live]))
            top[live[better]], count[live[better]] = s[better], k[better]
        best.append(np.zeros(len(order)))
        tokens.append(np.zeros(len(order), np.int64))
        best[d][at], tokens[d][at] = top, count
        ended = np.flatnonzero(lengths == d)
        result[ended] = tokens[d][node[d][ended]]
    out = [0] * len(order)
    for i, n in zip(order, result.tolist(), strict=True):
        out[i] = n
    return out


class Counter:
    """Counts of texts; the terminal counts of pre-tokens seen are kept up to max_kept of them."""

    def __init__(self, path: str | None = None, max_kept: int = MAX_TERMINALS):
        self.pieces, self.max_kept = Pieces(path), max_kept
        self.terminal: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.terminal) > self.max_kept:
            self.terminal.clear()
        p, known = self.pieces, self.terminal
        new = sorted((w for w in words if w not in known), key=len)
        while new:  # words of like length together: the rows of a trie are as wide as its longest word
            part = [w for w in new[:CHUNK] if len(w) <= 2 * len(new[0]) + 16]
            known.update(zip(part, trie_counts([MARK + w for w in part], p), strict=True))
            new = new[len(part) :]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each whole text."""
        split, p = [t.split() for t in texts], self.pieces
        distinct = set().union(*split)
        long = {w: segment(MARK + w, p.scores, p.longest, p.byte_score) for w in distinct if len(w) >= MAX_KEPT}
        self.learn(distinct - long.keys())
        known = self.terminal
        known.update(long)
        out = [(len(words), sum(map(known.__getitem__, words))) for words in split]
        for w in long:
            del known[w]
        return out


@lru_cache(maxsize=1)
def _counter(path: str | None) -> Counter:
    return Counter(path)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about SLICE characters together; a longer text is alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_pretokens, n_tokens) for every row, from its whole text, however long. Null or empty text: zeros. Empty table: no
    rows. Repeated rows get equal counts; other columns are ignored."""

    def kernel(batch: pa.RecordBatch) -> list:
        counter = _counter(path)
        both = [pair for part in _slices([t or "" for t in batch.column("__text").to_pylist()]) for pair in counter.count(part)]
        return [[n for n, _ in both], [n for _, n in both]]

    return append(id_text(docs, id_col, text_col), kernel, "n_pretokens bigint, n_tokens bigint").drop("__text")


def op1(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
