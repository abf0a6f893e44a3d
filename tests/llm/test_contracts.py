"""The eleven queries over the driver's smallest tables, held against brute force written from their contracts."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tessella.llm import html_extract, licenses, media, packing, token_counts
from tessella.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@cache
def source(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def get(prefix):
        name = next(q for q in QUERIES if q.startswith(prefix))
        if name not in kept:
            kept[name] = [r.asDict(True) for r in QUERIES[name](spark, SF).collect()]
        return kept[name]

    return get


def texts():
    return {d["doc_id"]: d["text"] or "" for d in source("documents")}


def test_op1_equals_segmenting_each_word_alone(result):
    scores = token_counts.pieces()
    for r in result("op1_")[:60]:
        words = texts()[r["doc_id"]].split()
        assert r["n_pretokens"] == len(words)
        assert r["n_tokens"] == sum(token_counts.segment("▁" + w, *scores) for w in words)
    assert len(result("op1_")) == len(texts())


def test_op2_base_spans(result):
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    for r in result("op2_"):
        found = sorted((m.start(), i, k, m.end()) for i, (k, (p, g, n)) in enumerate(kinds.items()) for m in p.finditer(texts()[r["doc_id"]]) if len(m[g]) >= n)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k, _ in found) for x in kinds)


def test_op3_is_accurate_on_held_out_rows(result):
    lang = {d["doc_id"]: d["lang"] for d in source("documents")}
    held = [r for r in result("op3_") if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in result("op3_"))
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in result("op3_"))


def test_op4_fingerprints_and_components(result):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
        return sum(1 << b for b, n in ones.items() if 2 * n > len(grams))

    fps = {i: fp(t) for i, t in texts().items()}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op4_")} == {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def test_op5_shards(result):
    rows, all_texts = result("op5_"), texts()
    per = defaultdict(list)
    mix = defaultdict(Counter)
    src = {d["doc_id"]: d["source"] for d in source("documents")}
    for r in rows:
        raw = all_texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        per[r["shard"]].append(r["slot"])
        mix[src[r["doc_id"]]][r["shard"]] += 1
    assert len(rows) == len(all_texts) and set(per) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for counts in mix.values():
        share = sum(counts.values()) / 40
        assert all(abs(counts[s] - share) <= 2.5 for s in range(40))


def test_op6_round_trip(result):
    for r in result("op6_"):
        raw = texts()[r["doc_id"]].encode()
        body = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        blob = media.encode_png(np.frombuffer(body, np.uint8).reshape(-1, 64))
        assert media.decode_png(blob).tobytes() == body
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())


def read_png(blob):
    """Samples of a grey PNG by the format's own description, byte by byte."""
    assert blob[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, width, height, data = 8, 0, 0, b""
    while at < len(blob):
        n, kind = int.from_bytes(blob[at : at + 4], "big"), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + n]
        assert int.from_bytes(blob[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows = zlib.decompress(data), []
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        row = []
        for x, v in enumerate(line[1:]):
            left, up = row[x - 1] if x else 0, rows[y - 1][x] if y else 0
            row.append((v + {0: 0, 1: left, 2: up}[line[0]]) % 256)
        rows.append(row)
    return rows


def plain_hash(rows, grid=32, low=8):
    """Area means by overlaps and the cosine transform by its sums."""
    def means(values):
        n, out = len(values), []
        for i in range(grid):
            a, b = i * n / grid, (i + 1) * n / grid
            out.append(sum(max(0.0, min(b, j + 1) - max(a, j)) * values[j] for j in range(int(a), min(n, int(b) + 1))) / (b - a))
        return out

    tall = [means(list(c)) for c in zip(*rows, strict=True)]
    cells = [means(list(r)) for r in zip(*tall, strict=True)]
    cos = [[np.cos(np.pi * (2 * x + 1) * k / (2 * grid)) for x in range(grid)] for k in range(low)]
    flat = [round(sum(cos[i][y] * cells[y][x] * cos[j][x] for y in range(grid) for x in range(grid)), 6) for i in range(low) for j in range(low)]
    middle = sorted(flat[1:])[31]
    bits = "0" + "".join(str(int(v > middle)) for v in flat[1:])
    return f"{int(bits, 2):016x}"


def test_op6_by_a_plain_reader_and_transform(result):
    for r in sorted(result("op6_"), key=lambda r: r["n_bytes"])[:60:6]:
        raw = texts()[r["doc_id"]].encode()
        body = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        blob = media.encode_png(np.frombuffer(body, np.uint8).reshape(-1, 64))
        rows = read_png(blob)
        assert bytes(v for row in rows for v in row) == body
        assert r["media_sha256"] == hashlib.sha256(blob).hexdigest() and r["feature"] == plain_hash(rows)


def test_op7_pieces(result):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in texts().items()}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in result("op7_"):
        mine = ids[r["doc_id"]]
        part = mine[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(mine)
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, mine in ids.items():
        at = 0
        for s, n in sorted(covered[i]):
            assert s == at
            at += n
        assert at == len(mine)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(sequences)) > 0.9


def test_op8_article_blocks(result):
    for r in result("op8_"):
        page = next(p["html"] for p in source("pages") if p["page_id"] == r["page_id"])
        body = page[page.index("<article>") + 9 : page.index("</article>") if "</article>" in page else len(page)]
        body = re.sub(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", "", body, flags=re.S)
        parts = re.split(r"</?(?:p|h\d|div|ul|ol|li|blockquote|table|tr|td|th|section|aside|form|pre)\b[^>]*>", body)
        plain = [" ".join(html_extract.entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in plain if x), r["page_id"]
        assert r["n_chars"] == len(r["text"])


def windows_of(words):
    return [tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))] if words else []


def test_op9_hits(result):
    items = defaultdict(set)
    for b in source("benchmark"):
        for w in windows_of(WORD.findall(b["text"].translate(UPPER))):
            items[w].add(b["item_id"])
    sizes = {len(w) for w in items}
    for r in result("op9_"):
        words = WORD.findall(texts()[r["doc_id"]].translate(UPPER))
        hit, seen = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in items:
                    hit |= set(range(i, i + n))
                    seen |= items[w]
        line = ",".join(sorted(map(str, seen)))
        want = (len(words), len(hit), len(seen), hashlib.sha256(line.encode()).hexdigest(), bool(hit))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    assert any(r["contaminated"] for r in result("op9_"))


def test_op10_base_places(result):
    for r in result("op10_"):
        words = WORD.findall(texts()[r["doc_id"]].translate(UPPER))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_packing_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 5000):
        h = np.bincount(rng.integers(1, 2049, n), minlength=2049)
        h[700] += n
        steps = packing.plan(h)
        used = np.zeros(2049, int)
        for c, k in steps:
            assert sum(c) <= 2048 and k > 0
            np.add.at(used, np.array(c), k)
        assert (used[1:] == h[1:]).all()


def near_copy_groups(ids):
    """{id: least id of its group}: components of five-word similarity 0.8 or more, by comparing all pairs that share a shingle."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", texts()[i].translate(UPPER)) for i in ids}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    holders, parent = defaultdict(list), {i: i for i in ids}
    for i in ids:
        for g in sets[i] or {()}:
            holders[g].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def test_most_packed_pieces_come_from_the_least_squares_solution():
    encode, h = packing.encoder(), np.zeros(2049, np.int64)
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        n = len(encode(text or "")) + 1
        h[2048] += n // 2048
        h[n % 2048] += n % 2048 > 0
    solved, left = packing.solution(h)
    assert all(sum(c) == 2048 for c, _ in solved)
    used = sum(k * len(c) for c, k in solved if len(c) > 1)
    assert used + left.sum() == h[:2048].sum() and used >= 0.8 * h[:2048].sum()


def test_pipeline_equals_brute_force(spark, result):
    """Stages two to five recomputed in plain Python from what language ID keeps."""
    from tessella.llm import langid, secrets
    from tessella.llm.common import table

    docs = table(spark, SF, "documents")
    known = {r["doc_id"] for r in langid.stage(spark, docs, SF).collect()}
    group = near_copy_groups(sorted(known))
    assert any(group[i] != i and texts()[i] != texts()[group[i]] for i in known)
    clean = {r["doc_id"] for r in result("op9_") if not r["contaminated"]}
    kept = {i for i in known if group[i] == i and i in clean}
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in result("op2_")}
    encode = packing.encoder()
    want = {}
    for i in kept:
        text, at, out = texts()[i], 0, []
        for _, a, b in sorted(spans[i], key=lambda s: int(s[1])):
            if int(a) >= at:
                out += [text[at : int(a)], secrets.MASK]
            at = max(at, int(b))
        want[i] = struct.pack(f"<{(n := len(ids := [*encode(''.join(out) + text[at:]), 1]))}I", *ids), n
    got = defaultdict(int)
    rows = result("pipeline")
    assert {r["doc_id"] for r in rows} == kept
    for r in rows:
        raw, n = want[r["doc_id"]]
        assert r["doc_tokens"] == n
        assert r["ids_crc32"] == zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])])
        got[r["doc_id"]] += r["length"]
    assert all(got[i] == want[i][1] for i in kept)


def test_op7_ids_of_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    samples = ["<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "<|EndOfText|> <|endoftext|>é", "", "".join(map(chr, range(0x250))), "\x00\x07\ufeff\u200d\u0301", "a\r\n\t  \u00a0\u2003b  ", "😀" * 50]
    samples += ["ab" * 50_000, "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), 100_000)), " " * 10_000, "1" * 10_000, "!?" * 5_000]
    samples += pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    assert [encode(t) for t in samples] == [tok.encode(t, add_special_tokens=False).ids for t in samples]
