"""Tokens, fingerprints, lines and searches against brute force or a reference library."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palate.llm import bpe, line_dedup, queries, simhash, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "Ab ab AB", "it's  don't", "<|endoftext|>x<|endoftext|>", "<|endof", "日本語 é ñ 😀", "x" * 30_000, "\x00\x1c\x85\u2028 z", "a\tb\x0bc", "1234567", "the the the the the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def mine():
    return bpe.BpeTokenizer(Path(PATH).read_text())


def test_ids_equal_the_library(library, mine):
    rng = np.random.default_rng(5)
    parts = ["ab", "A", " ", "  ", "\n", "aaaa", "the", "'s", "é", "日", "<|endoftext|>", "123", "!!", "\t", "😀", "zq", "ing", "\u00a0"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point(library, mine):
    texts = [f"{chr(c)}a {chr(c)}{chr(c)}1{chr(c)}!" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert [mine.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_and_decode_frames(spark, library):
    spec = Path(PATH).read_text()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, spec), spec).orderBy("doc_id").collect()
    assert bpe.encode_and_decode(df.withColumn("made", F.lit(1)), spec).drop("made").orderBy("doc_id").collect() == got
    for t, r in zip(ODD, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    odd_ids = spark.createDataFrame([([262, -5, 999_999, 262],), (None,), ([],), ([None, 262],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd_ids, spec).collect()] == [" the the", "", "", " the"]
    assert bpe.encode(df.limit(0), spec).count() == 0


def test_pieces_in_use_stay_known(library):
    """Ever new pieces neither drive out those in use nor fill the memory; the ids stay the same."""
    mine = bpe.BpeTokenizer(Path(PATH).read_text())
    worked_out, encode = Counter(), mine.pieces.encode
    mine.pieces.encode = lambda piece: worked_out.update([piece]) or encode(piece)
    rng = np.random.default_rng(11)
    for k in range(60):
        text = " the of".join(" " + "".join(letters) for letters in rng.choice(list("abcdefghij"), (4000, 9)).tolist())
        ids = mine.encode(text)
        if k % 20 == 19:
            assert ids == library.encode(text, add_special_tokens=False).ids
    assert sum(worked_out.values()) > 230_000 and worked_out[" the"] == worked_out[" of"] == 1
    held = [sum(sys.getsizeof(p) + sys.getsizeof(i) for p, i in part.items()) for part in (mine.pieces, mine.pieces.older)]
    assert max(held) <= bpe.PIECE_BYTES // 2 and min(held) > 0


def test_op1_query(spark, sf, library):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op1_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_fingerprint(text, n=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ODD)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [100, 40_000_000, 4_000_000_000])
def test_blocks_grow_with_the_table(spark, n):
    """More blocks, as for larger tables, find the same links."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = np.unique(np.array([int(b) ^ sum(1 << int(x) for x in rng.choice(64, k % 6, replace=False)) for k in range(12) for b in base], np.uint64))
    ids = list(range(len(prints)))
    at = {int(p): i for i, p in zip(ids, prints.view(np.int64), strict=True)}
    links = simhash.near_edges(spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long"), 4, n=n).collect()
    got = dict.fromkeys(ids) | dict(simhash.components(spark.createDataFrame([(at[r.a], at[r.b]) for r in links], "a long, b long")).collect())
    assert {i: (got[i] if got[i] is not None else i) for i in ids} == plain_components(prints, ids, 4)


def plain_components(prints, ids, radius):
    parent = dict(zip(ids, ids, strict=True))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints ^ a) <= radius):
            x, y = sorted((find(ids[i]), find(ids[int(j)])))
            parent[y] = x
    return {i: find(i) for i in ids}


def test_bit_planes():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**63, 700, dtype=np.uint64)
    prints[100:200] = prints[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    planes = simhash.BitPlanes(prints)
    for radius in (1, 3, 4, 7):
        for q in (0, 5, 150):
            assert planes.within(int(prints[q]), radius).tolist() == np.flatnonzero(np.bitwise_count(prints ^ prints[q]) <= radius).tolist()


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 16])
def test_links_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    prints = np.unique(np.array([int(b ^ flips(k % 7 + 1)) for k in range(20) for b in base], np.uint64))
    ids = list(range(len(prints)))
    nodes = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    at = {int(p): i for i, p in zip(ids, prints.view(np.int64), strict=True)}
    edges = spark.createDataFrame([(at[r.a], at[r.b]) for r in simhash.near_edges(nodes, 4, chunk).collect()], "a long, b long")
    got = dict.fromkeys(ids)
    got |= dict(simhash.components(edges).collect())
    want = plain_components(prints, ids, 4)
    assert {i: (got[i] if got[i] is not None else i) for i in ids} == want


def test_near_duplicates_of_odd_rows(spark):
    text = "one two three four five six seven eight nine ten " * 5
    rows = [(1, None), (2, ""), (3, text), (4, text), (4, text), (5, text.upper()), (None, text), (6, "something else altogether here")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, 3), (6, 6)}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    shared = "A line that is Shared"
    rows = [(3, f"{shared}\nown line of three\n{shared}"), (1, f"  {shared.lower()}\t\nshort"), (2, "short\nshort\n"), (4, None), (5, ""), (6, f"{shared}"), (7, "own line of seven\nown line of seven"), (8, "ünïque LÄNGE line ten\nx"), (9, "ünïque lÄnge line ten")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_lines int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == plain_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(spark.createDataFrame([(1, shared), (1, shared), (2, shared)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_dropped) for r in twice.collect()) == [(1, 0), (1, 0), (2, 1)]


def test_lines_of_long_and_clashing_rows(spark):
    line = "a line that both of them hold"
    rows = [(1, "own " * 400_000 + "\n" + line, "a"), (2, line + "\nx" * 200_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string").withColumns({"null": F.lit(1), "th": F.lit(2), "cut": F.lit(3)})
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "x\n" * 199_999 + "x" and got[2].n_dropped == 1
    assert (got[2].d, got[2]["null"], got[2].th, got[2].cut) == ("b", 1, 2, 3)


def plain_top(vectors, k):
    out = set()
    for q, v in vectors:
        if q % 20 == 0:
            ranked = sorted(((-int(np.dot(v, w)), i) for i, w in vectors if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("copies", [0, 60])
def test_top_k_equals_brute_force(spark, copies):
    rng = np.random.default_rng(4)
    vectors = [(i, np.floor(64 * rng.normal(size=16) * rng.choice([0.1, 1, 4])).astype(int)) for i in range(300)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(copies)]
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in vectors], "id long, vector array<long>")
    got = {tuple(r) for r in topk.top_k(df, df.filter("id % 20 = 0"), 20).collect()}
    assert got == plain_top(vectors, 20)


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.3]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (20, [0.01, -0.01])]
    v = topk.to_integers(spark.createDataFrame(rows, "id long, vector array<float>"), "vector")
    assert {r.id: list(r.vector) for r in v.collect()} == {0: [64, 128], 1: [32, -20], 20: [0, -1]}
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, -128), (0, 2, 1, -512), (20, 1, 1, 20), (20, 2, 0, -128)]
    assert topk.top_k(v.limit(0), v.limit(0), 20).count() == 0


def test_top_k_of_blocks_repeats_and_empty_vectors(spark, monkeypatch):
    """Many small blocks; repeated rows rank as the rows they are; the empty vector scores 0; scores beyond 62 bits are refused."""
    monkeypatch.setattr(topk, "LEAST_BLOCK", 20)
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-90, 90, 6).tolist()) for i in range(200)] + [(7, [3] * 6), (7, [3] * 6), (300, []), (301, [50])]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    width = lambda v: np.array([*v, *[0] * (6 - len(v))])
    want = set()
    for q, v in [r for r in rows if r[0] % 20 == 0]:
        ranked = sorted((-int(width(v) @ width(w)), i) for i, w in rows if i != q)[:20]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    assert {tuple(r) for r in topk.top_k(df, df.filter("id % 20 = 0"), 20).collect()} == want
    huge = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "id long, vector array<long>")
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(huge, huge, 1).collect()


def test_op10_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = [(r.vec_id, np.floor(64 * np.array(r.embedding, float)).astype(int)) for r in rows]
    assert {tuple(r) for r in queries.op10_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()} == plain_top(vectors, 20)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_duckdb(spark, sf, name):
    from oracle_check import connect, same_rows

    same_rows(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


def test_op2_query(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    ids = sorted(texts)
    prints = np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64)
    want = plain_components(prints, ids, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{int(p):016x}", want[i]) for i, p in zip(ids, prints, strict=True)}
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_links_run_through_documents_without_an_id(spark):
    """A and B are too far apart, N (no id) is near both."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 300))
    for seed in range(4000):
        r = np.random.default_rng(seed)
        a, b = list(base), list(base)
        for t in (a, b):
            for k in r.choice(300, 4, replace=False):
                t[k] = f"x{r.integers(0, 10**6)}"
        apart = lambda x, y: (simhash.fingerprint(" ".join(x)) ^ simhash.fingerprint(" ".join(y))).bit_count()
        if apart(a, b) > 4 and apart(a, base) <= 4 and apart(b, base) <= 4:
            break
    rows = [(1, " ".join(a)), (2, " ".join(b)), (None, " ".join(base)), (7, "quite another text"), (None, "and one that nothing is near")]
    for rows_ in (rows, [(3 if d is None and k == 2 else d, t) for k, (d, t) in enumerate(rows)]):
        got = simhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3)) == [(False, d, 1) for d, _ in rows_ if d in (1, 2, 3)]
        assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted(["1", "None"] if rows_ is rows else ["None"])


def test_smaller_similarities_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for run in (simhash.similar_documents, simhash.drop_similar):
        with pytest.raises(ValueError):
            run(df, similarity=0.5)
    assert simhash.similar_documents(df, similarity=0.9).count() == 1
