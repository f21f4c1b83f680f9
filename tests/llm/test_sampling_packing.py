"""Resampling, periodic runs and packing against brute force, the tokenizers library and exact round trips."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact import ODD, PATH
from tokenizers import Tokenizer

from palate.llm import packing, periodic, queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text, n=2):
    w = WORD.findall(plain_lower(text))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_draw(docs, target, buckets=10_000, percent=25, least=20):
    """(n_features, weight, score, rank) of every row, by the definition."""
    made = [plain_features(t) for _, t in docs]
    hashed = lambda fs: Counter(crc32(f.encode()) % buckets for f in fs)
    s, t = Counter(), Counter()
    for _, fs in made:
        s += hashed(fs)
    for x in target:
        t += hashed(plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for (d, _), (w, fs) in zip(docs, made, strict=True):
        weight = math.floor(sum(gain(b) * n for b, n in hashed(fs).items()) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {id(r): k + 1 for k, r in enumerate(may) if k < percent * len(may) // 100}
    return sorted((tuple(r[:4]) + (places.get(id(r)),) for r in rows), key=str)


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "GAMMA", "x1", "é", "日本", "delta-echo", "_", "!"], n))


def test_draw_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [*ODD, *(prose(rng, int(rng.integers(0, 90))) for _ in range(60)), prose(rng, 3000), "word" * 5000, "a  " * 4000 + "b"]
    docs = list(enumerate(texts)) + [(3, texts[30]), (30, texts[30]), (None, texts[31]), (None, texts[31])] + [(500 + i, texts[40]) for i in range(20)]
    docs += [(700, texts[-3]), (700, texts[-3])]
    bench = [prose(rng, 50) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, h1 int, rank int")
    aim = spark.createDataFrame([(t,) for t in bench], "text string")
    want = plain_draw(docs, bench)
    for size in (64, 1 << 16):  # chunks of a few words give the same
        got = resample.draw(df, aim, chunk_bytes=size).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    drawn = resample.resample(df, aim)
    assert drawn.columns == df.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(w[0] for w in want if w[4] is not None)


def test_chunks_own_every_feature_once():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3):
        for text in (prose(rng, 400), "a" * 700 + " b", "  x  " * 90, "", " ", "é" * 300):
            w = resample.text_words(text)
            parts = [(a.split(), b.split()) for a, b in resample.chunks(text, n, 50)]
            assert [x for a, _ in parts for x in a] == w
            split = [h for a, b in parts for h in resample.feature_hashes(a + b, len(a), n)]
            assert sorted(split) == sorted(resample.feature_hashes(w, len(w), n)) == sorted(crc32(f.encode()) for f in plain_features(text, n)[1])
    assert len(list(resample.chunks("ab " * 1000, 2, 50))) > 30


def test_draw_of_empty_tables_and_targets(spark):
    df = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.draw(none, df).count() == 0 and resample.resample(none, df).count() == 0
    assert sorted(tuple(r) for r in resample.draw(df, none).select("doc_id", "n_features", "weight", "score").collect()) == sorted(x[:4] for x in plain_draw([(1, "a " * 30), (2, None)], []))


def test_draw_follows_the_target(spark):
    """Documents like the target are drawn far more often, others still are."""
    rng = np.random.default_rng(6)
    of = lambda k: " ".join(f"{'like' if rng.random() < k else 'other'}{rng.integers(0, 40)}" for _ in range(60))
    df = spark.createDataFrame([(i, of(0.8 if i % 4 == 0 else 0.2)) for i in range(2000)], "doc_id long, text string")
    aim = spark.createDataFrame([(of(0.8),) for _ in range(50)], "text string")
    rows = resample.draw(df, aim).filter("rank is not null").collect()
    assert sorted(r.rank for r in rows) == list(range(1, 501))
    assert 0.4 < sum(r.doc_id % 4 == 0 for r in rows) / 500 < 0.95


def plain_runs(words, shortest=12):
    """(start, length, period) by definition: every maximal stretch of every period, kept if no smaller period does."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= shortest:
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, size, q) for (s, size), q in found.items())


def run_texts(rng):
    base = ["a", "b", "c", "d", "e", "f"]
    for k in range(220):
        parts = [list(rng.choice(base[: int(rng.integers(1, 7))], int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 5)))]
        yield [w for p in parts for w in p * int(rng.integers(1, 5))]
    yield ["x"] * 500
    yield ["x", "y"] * 301
    fib = ["a"], ["a", "b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]


def test_runs_against_brute_force():
    texts = list(run_texts(np.random.default_rng(8)))
    known = {}
    numbers = np.array([known.setdefault(w, len(known)) for ws in texts for w in ws])
    want = [(t, *r) for t, ws in enumerate(texts) for r in plain_runs(ws)]
    for block in (1 << 21, 500):
        assert [tuple(r) for r in periodic.runs_of(numbers, np.array([len(ws) for ws in texts]), block=block).tolist()] == want
    assert any(r[0] == len(texts) - 1 for r in want) and len(want) > 300
    for shortest in (2, 5, 40):
        got = periodic.runs_of(numbers, np.array([len(ws) for ws in texts]), shortest)
        assert [tuple(r) for r in got.tolist()] == [(t, *r) for t, ws in enumerate(texts) for r in plain_runs(ws, shortest)]


def plain_op12(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *top, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_op12_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: plain_op12(d, t) for d, t in docs if len(t or "") < 20_000}
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs) and {d: got[d] for d in want} == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_odd_texts_of_runs(spark):
    texts = [*ODD, "a b " * 20, "p q r s t u " * 2, "p q r s t u " * 2 + "p", "x y " * 6]
    df = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, runs int, made int")
    got = periodic.collapse_runs(df.unionByName(df)).collect()
    assert len(got) == 2 * len(texts) and set(df.columns) < set(got[0].__fields__)
    for r in got:
        w = (texts[r.doc_id or 0] or "").encode().split()
        want = plain_runs(w)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        assert [tuple(x) for x in r.runs] == want and r.collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert periodic.collapse_runs(df.limit(0)).count() == 0


def test_long_texts_of_runs():
    rng, start = np.random.default_rng(1), time.time()
    plain = rng.integers(0, 5000, 300_000)
    planted = np.concatenate([plain[:1000], np.tile(plain[1000:8000], 5), plain[8000:]])
    found = periodic.runs_of(np.concatenate([planted, np.zeros(200_000, np.int64)]), np.array([len(planted), 200_000]))
    assert [1, 0, 200_000, 1] in found.tolist()
    best = max(found[found[:, 0] == 0].tolist(), key=lambda r: r[2])
    assert best[3] == 7000 and best[2] >= 35_000
    assert time.time() - start < 60


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check_pieces(rows, ids_of):
    """Rows of all pieces; ids_of: the ids of every document row by id, with the one that ends it."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.length > 0
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        left = Counter(tuple(x) for x in ids_of[d])
        want = Counter()
        for x, n in left.items():
            for p in pieces:
                if p.doc_tokens == len(x) and p.ids_crc32 == crc32(np.array(x[p.start : p.start + p.length], "<u4")):
                    want[x] += p.length
        assert sum(p.length for p in pieces) == sum(map(len, ids_of[d]))
        assert all(want[x] >= n * len(x) for x, n in left.items())
        if len(ids_of[d]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(ids_of[d][0])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return by_sequence, padding


def test_packing_round_trip(spark, library):
    rng = np.random.default_rng(3)
    texts = [*ODD, *(prose(rng, int(rng.integers(1, 700))) for _ in range(150)), prose(rng, 9000), " " * 400_000, "\n" * 300_000 + "x"]
    docs = list(enumerate(texts)) + [(5, texts[20]), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, start int").repartition(3)
    ids_of = defaultdict(list)
    for d, t in docs:
        ids_of[d].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    made = packing.pack(df, queries.vocabulary())
    rows = made.collect()
    sequences, padding = check_pieces(rows, ids_of)
    assert padding == 0
    assert all(sum(p.length for p in s) == s[0].window for s in sequences.values())
    assert all(crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack(df.limit(0), queries.vocabulary()).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, queries.vocabulary(), tiers=(100, 1024))


def test_op13_query(spark, sf, library):
    ids_of = {r.doc_id: [[*library.encode(r.text or "", add_special_tokens=False).ids, 0]] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_packing(spark, sf).collect()
    sequences, padding = check_pieces(rows, ids_of)
    assert padding == 0
    sizes = Counter(r.window for r in rows if r.offset == 0)
    assert sum(n for w, n in sizes.items() if w < 128) <= 30  # only what is left at the end of a task is short
    least = sum(-(-len(x[0]) // 1024) for x in ids_of.values())
    assert len(rows) <= least + len(sequences)  # a window cuts one document at most
    weight = Counter()
    for s in sequences.values():
        weight[s[0].step_group] += s[0].window
    assert len(weight) == 1 or max(weight.values()) - min(weight.values()) <= 4096


def test_encoder_equals_the_library(library):
    encoder = packing.Encoder(queries.vocabulary())
    for t in [*ODD, *(f"{chr(c)}a {chr(c)}{chr(c)}1{chr(c)}! {chr(c)}" for c in range(0, 0x30000, 11) if not 0xD800 <= c < 0xE000)]:
        assert encoder.encode(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_long_windows_are_filled_from_shorter_tiers():
    packer = packing.Packer()
    for k, size in enumerate([900, 124, 600, 300, 100, 24, 500, 12]):
        packer.add(k, 0, size)
    full = list(packer.pack())
    assert [sorted(x[2] for x in s) for s in full] == [[124, 900], [24, 100, 300, 600], [12, 500]]
    for k, size in enumerate([700, 90, 60]):
        packer.add(k, 0, size)
    assert not list(packer.pack()) and sum(x[2] for w in packer.open.values() for x in w) == 850
    rest = list(packer.rest())
    assert [sum(x[2] for x in s) for s in rest] == [512, 256, 64, 16, 2] and not packer.open and not packer.waiting
