"""The pipeline's stages, each on its own input, against brute force; and what is planted must go while clean documents stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact import PATH, plain_lines
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from palate.llm import simhash
from palate.llm.common import staged


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (rows before, rows after) over a small table."""
    folder = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        after = staged(stage(spark, docs, folder))
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    for name, _ in pipeline.STAGES[:-1]:
        assert stages[name][1][0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    before, after = ({r.doc_id for r in rows} for rows in stages["toxicity"])
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in clean) >= 0.98 * len(clean)
    assert sum(labels.get(d) == 1 for d in after) <= 0.2 * sum(labels.get(d) == 1 for d in before)


def test_lines_are_cut_exactly(stages):
    before, after = stages["line_dedup"]
    want = plain_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {d: w[2] for d, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in after)


def overlap(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash_near_dedup"]
    texts, kept = {r.doc_id: r.text for r in before}, [r.doc_id for r in after]
    assert len(kept) == len(set(kept))
    for i, a in enumerate(kept):
        assert not any(overlap(texts[a], texts[b]) >= 0.8 for b in kept[i + 1 :])
    for gone in set(texts) - set(kept):
        assert any(overlap(texts[gone], texts[d]) >= 0.8 for d in texts if d < gone)


def test_no_document_is_lost_in_the_mix(stages):
    before, after = stages["mixing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert sum(len((r.text or "").split()) for r in after) <= 2.1 * sum(len((r.text or "").split()) for r in before)


def test_the_mix_nears_its_targets(spark, stages):
    """By the labels: texts of low quality, else the language."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    targets = pipeline.MIX_TARGETS

    def shares(rows):
        n = dict.fromkeys(targets, 0)
        for r in rows:
            domain = "low" if labels.get(r.doc_id) == 0 else r.lang
            if domain in n:
                n[domain] += len((r.text or "").split())
        return {d: x / sum(n.values()) for d, x in n.items()}

    before, after = map(shares, stages["mixing"])
    off = lambda found: sum(abs(found[d] - targets[d]) for d in targets)
    assert off(after) < 0.6 * off(before) or off(after) < 0.1


ODD_DOCS = [(None, "a text without an id that is here once", None, None, None), (1, None, "en", "s", 0), (1, "repeated id, other text", "en", "s", 1), (2, "", "en", None, 0), (3, "same row", "fr", "t", 8), (3, "same row", "fr", "t", 8), (4, "word " * 250_000, "en", "s", 1)]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
@pytest.mark.filterwarnings("ignore:tokens reached")
def test_stages_on_odd_tables(spark, name):
    stage, folder = dict(pipeline.STAGES)[name], "/root/testdata/sf0.001"
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"copies": F.lit("x"), "t1": F.lit("y")})
    got = stage(spark, docs, folder).collect()
    held = {"toxicity": 7, "line_dedup": 7, "simhash_near_dedup": 5, "bpe": 7}
    if name in held:
        assert len(got) == held[name]
    else:
        assert {r.doc_id for r in got} == {None, 1, 2, 3, 4} and len(got) >= 7
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_tokens(stages):
    library = Tokenizer.from_file(PATH)
    before, after = stages["bpe"]
    texts = {r.doc_id: r.text or "" for r in before}
    assert len(before) == len(after)
    for r in after:
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_planted_copies(spark):
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    near = base.replace("w7919", "x", 1).replace("w838", "y", 1)
    far = " ".join(f"v{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, near), (1, far), (2, None), (4, ""), (7, "short text"), (8, "short text")]
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 2, 4: 2, 7: 7, 8: 7}
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited_copies(seed, n=300, length=400):
    """A master and copies that overlap by 0.8 or more with it and less with one another, each with edits of its own."""
    rng = np.random.default_rng(seed)
    master = [f"m{seed}x{i}" for i in range(length)]
    rows = [(1000 * seed + n, " ".join(master))]
    for k in range(n):
        words = list(master)
        for at in rng.choice(length // 8, 8, replace=False) * 8:
            words[at + 4] = f"e{seed}x{k}x{at}"
        rows.append((1000 * seed + k, " ".join(words)))
    return rows


def test_copies_that_only_the_master_joins(spark):
    rows = edited_copies(1)
    texts = dict(rows)
    assert overlap(texts[1000], texts[1300]) >= 0.8 > overlap(texts[1000], texts[1001])
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(c == 1000 for c in got.values()) >= 0.97 * len(rows)


def test_links_inside_a_template(spark):
    """Texts of one template in pairs: 0.8 or more within a pair, 0.6 to 0.7 between them. No pair is lost, no two are joined."""
    rng, rows = np.random.default_rng(8), []
    template = [f"t{k}" for k in range(300)]
    for i in range(600):
        words = list(template)
        for at in rng.choice(30, 8, replace=False) * 10:  # eight words of its own break forty of some 300 shingles
            words[at + 5] = f"f{i}x{at}"
        again = list(words)
        again[int(rng.integers(0, 300))] = f"g{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(again))]
    texts = dict(rows)
    assert overlap(texts[0], texts[1]) >= 0.8 and max(overlap(texts[0], texts[k]) for k in range(2, 200)) < 0.8
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert sum(got[2 * i + 1] == 2 * i for i in range(600)) >= 0.99 * 600
    assert len(set(got.values())) >= 590


def test_rows_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, 0), (1, "another text altogether that has its own words", 0), (2, base + " end", 1), (None, base, 2), (3, "quite short", 3), (3, "quite short", 4), (None, "only without id", 5), (4, None, 6), (5, "", 7)]
    got = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, t1 int")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, base), (1, rows[1][1]), (3, "quite short"), (0, "only without id"), (4, "")])


def test_one_repeated_run_makes_no_copies(spark):
    rows = [(i, "0 " * 500 + " ".join(f"t{i}w{k}" for k in range(60))) for i in range(6)]
    rows += [(10, rows[0][1]), (11, "0 " * 300 + rows[0][1])]  # the same set of shingles
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: i for i in range(6)} | {10: 0, 11: 0}


def test_recall_of_links_just_over_the_bound(spark):
    """Pairs that overlap by 0.80 to 0.83, and pairs that differ in how often a passage is repeated, too."""
    rng, rows = np.random.default_rng(4), []
    for i in range(1500):
        n = int(rng.integers(60, 400))
        words = [f"r{i}x{k}" for k in range(n)]
        cut = round(0.183 * n)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[cut:]))]
    for i in range(1500, 1600):
        words = " ".join(f"r{i}x{k}" for k in range(100))
        rows += [(2 * i, words), (2 * i + 1, words + " go" + f" r{i} say it all again" * 400)]
    texts = dict(rows)
    linked = [i for i in range(1600) if 0.8 <= overlap(texts[2 * i], texts[2 * i + 1]) < (0.83 if i < 1500 else 1)]
    assert len(linked) > 1000 and linked[-1] >= 1500
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    for some in ([i for i in linked if i < 1500], [i for i in linked if i >= 1500]):
        assert sum(got[2 * i] == got[2 * i + 1] for i in some) >= 0.99 * len(some)


def test_short_texts_meet(spark):
    """Four shingles of five are shared."""
    rows = [(10 * i + k, " ".join(f"s{i}x{j}" for j in range(9 - k))) for i in range(600) for k in range(2)]
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert sum(got[10 * i + 1] == 10 * i for i in range(600)) >= 0.99 * 600
