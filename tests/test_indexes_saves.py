"""Indexes against scans, saves that break off, statistics of constant users, and the second plan of the candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.functions import scalars as S
from palate.operators import candidates, text, usermodel
from palate.plans import queries as plans
from palate.sources import saves
from palate.sources.projection import Tables


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_neighbours_equal_brute_force_without_a_nested_loop(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centre[i % 12] + 0.2 * rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000, [0.0] * 8), (2001, [2 * x for x in rows[5][1]])]
    vectors = spark.createDataFrame(rows, "item_id long, vec array<double>")
    asked = vectors.filter("item_id % 7 = 0").select("item_id").unionByName(vectors.filter("item_id = 7").select("item_id"))
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if np.linalg.norm(v) > 0}
    for top, centres in ((10, 32), (3, 1), (700, 8)):
        df = text.similar(asked, vectors, top, centres)
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
        got = {}
        for r in df.collect():
            got.setdefault(r.item_id, {})[r.rank] = (r.other_id, r.similarity)
        assert set(got) == {i for i in x if i % 7 == 0}
        for i, found in got.items():
            want = sorted((-float(x[i] @ v), j) for j, v in x.items() if j != i)[:top]
            assert len(found) == len(want)
            np.testing.assert_allclose([found[k + 1][1] for k in range(len(want))], [-s for s, _ in want], atol=1e-9)
    none = vectors.filter("item_id = 2000")
    assert text.similar(none, none).count() == 0 and text.similar(asked, none).count() == 0


def test_trigram_index_equals_the_scan(spark):
    rng = np.random.default_rng(1)
    words = ["blue", "widget", "frozen", "bolt", "brass", "steel", "small", "Été", "x"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 5))))) for i in range(400)] + [(400, None), (401, "")]
    items = spark.createDataFrame(rows, "item_id long, title string")
    asked = spark.createDataFrame([("blue wigdet",), ("brass",), ("ÉTÉ x",), ("",), ("!!",), ("zzzzqq",)], "query string")
    postings = text.trigram_postings(items)
    for threshold in (0.3, 0.6, 1.0):
        found = text.trigram_matches(asked, postings, threshold)
        assert "PushedFilters: [IsNotNull(gram), In(gram" in plan_of(found) or "In(gram" in plan_of(found)
        got = {(r.query, r.item_id): r.similarity for r in found.collect()}
        scan = asked.crossJoin(items).withColumn("s", S.trigram_similarity("title", F.col("query"))).filter(F.col("s") >= threshold).collect()
        assert got == {(r.query, r.item_id): pytest.approx(r.s) for r in scan}


def test_a_save_that_breaks_off_leaves_the_old_lists(spark, tmp_path):
    store = saves.ListStore(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read("result")
    lists = lambda k: {"result": spark.range(k).toDF("item_id"), "shortlist": spark.range(2 * k).toDF("item_id"), "impressions": spark.range(1).toDF("item_id")}
    first = store.save(lists(3))
    assert (store.read("result").count(), store.read("shortlist").count()) == (3, 6)
    broken = lists(9)
    broken["shortlist"] = broken["shortlist"].withColumn("bad", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.save(broken)
    assert store.version() == first and (store.read("result").count(), store.read("shortlist").count()) == (3, 6)
    second = store.save(lists(4))
    assert second == first + 1 and store.read("result").count() == 4 and store.read("shortlist", first).count() == 6
    store.prune(1)
    assert store.read("shortlist").count() == 8 and len(list((tmp_path / "store" / "versions").iterdir())) == 1
    assert store.save(lists(2)) == second + 1


def test_two_saves_at_once_take_numbers_of_their_own(spark, tmp_path):
    store = saves.ListStore(spark, str(tmp_path / "store"))
    names = [f"{k:032x}" for k in range(3)]
    assert [store._switch(n) for n in names] == [1, 2, 3]
    other = saves.ListStore(spark, str(tmp_path / "store"))
    other._numbers = lambda: [1]  # looked before the others had switched
    assert other._switch("f" * 32) == 4 and store._name(4) == "f" * 32


def test_constant_users_have_no_correlation_and_do_not_fail(spark):
    rows = [(1, i, 5.0, 7.0) for i in range(25)] + [(2, i, float(i % 7), float(i % 5)) for i in range(25)] + [(3, i, float(i % 3), 4.0) for i in range(25)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, stack double, personal double")
    for scale in ("raw", "z", "resid"):
        got = {(r.user_id, r.item_id): r.gap for r in usermodel.disagreement(df, df, scale).collect()}
        assert all(g is not None for g in got.values())
        if scale != "raw":
            assert {g for (u, _), g in got.items() if u != 2} == {0.0}
    rho = {r.user_id: r.rho for r in df.groupBy("user_id").agg(S.correlation("stack", "personal").alias("rho")).collect()}
    assert rho[1] is None and rho[3] is None
    assert rho[2] == pytest.approx(np.corrcoef([i % 7 for i in range(25)], [i % 5 for i in range(25)])[0, 1])


def test_reference_titles_are_the_most_scored_unrated_ones(spark):
    items = spark.createDataFrame([(i, "ova" if i % 5 == 0 else "tv", (i * 37) % 50) for i in range(60)] + [(99, "tv", None)], "item_id long, media_type string, scorers int")
    rated = spark.createDataFrame([(1, i) for i in range(0, 60, 2)] + [(2, 1)], "user_id long, item_id long")
    got = {}
    for r in usermodel.reference_titles(items, rated, 6).collect():
        got.setdefault(r.user_id, set()).add(r.item_id)
    main = sorted((-((i * 37) % 50), i) for i in range(60) if i % 5)
    own = {1: set(range(0, 60, 2)), 2: {1}}
    for u, rated_ in own.items():
        assert got[u] == set([i for _, i in main[:48] if i not in rated_][:6])


def test_level_curves_are_neutral_today(spark):
    days = [("2001-01-01",), ("2000-01-01",), ("1990-06-01",), (None,)]
    df = spark.createDataFrame([(1, k, d) for k, (d,) in enumerate(days)], "user_id long, item_id long, d string").withColumn("rated_at", F.to_date("d"))
    for kind in ("lin3", "log", "power"):
        got = {r.item_id: r.age_y for r in usermodel.level_trend(df, kind).collect()}
        assert got[0] == 0 and got[3] == 0 and abs(got[2]) > abs(got[1]) > 0
    with pytest.raises(ValueError):
        usermodel.level_trend(df, "other")


@pytest.mark.parametrize("name", ["cnd1_eligible", "flagship_top_lists"])
def test_pools_beyond_the_broadcast_give_the_same_lists(spark, sf, monkeypatch, name):
    t = Tables(spark, sf)
    want = sorted(map(tuple, plans.QUERIES[name](t).collect()), key=str)
    monkeypatch.setattr(candidates, "POOL_BROADCAST", 0)
    assert sorted(map(tuple, plans.QUERIES[name](Tables(spark, sf)).collect()), key=str) == want
