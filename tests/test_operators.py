import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palate.functions import scalars as S
from palate.operators import affinity, candidates, evaluate, graph, population, rerank, usermodel
from palate.settings import Settings
from palate.sources import merge


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- graphs ----
def test_closure_ends_on_cycles_and_never_names_the_title_itself(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (6, 1), (8, 9), (9, 8)], "item_id long, prequel_id long")
    assert rows(graph.prequel_closure(links)) == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 3), (4, 2, 2), (4, 3, 1), (6, 1, 1), (8, 9, 1), (9, 8, 1)]


def test_only_main_formats_are_required(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "item_id long, prequel_id long")
    items = spark.createDataFrame([(1, "tv"), (2, "ova"), (3, "tv"), (4, "tv")], "item_id long, media_type string")
    done = spark.createDataFrame([(7, 1, "completed", 8)], "user_id long, item_id long, status string, score int")
    pairs = spark.createDataFrame([(7, 3), (7, 4)], "user_id long, item_id long")
    assert rows(graph.satisfied(pairs, graph.prequel_closure(links), items, done)) == [(7, 3)]


def test_a_crossover_joins_one_series_and_bridges_none(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11, 99, 20, 21, 30, 50)], "item_id long")
    rel = spark.createDataFrame(
        [(1, 2, "sequel"), (2, 3, "sequel"), (10, 11, "sequel"), (99, 1, "side_story"), (99, 10, "side_story"), (20, 21, "side_story"), (30, 20, "spin_off"), (50, 1, "other")], "src long, dst long, relation_type string"
    )
    got = {r[0]: (r[1], r[2]) for r in graph.series_and_franchise(nodes, rel).select("item_id", "series_id", "franchise_id").collect()}
    assert got[99][0] == got[1][0] and got[10][0] != got[1][0]
    assert got[30][0] != got[20][0] and got[30][1] == got[20][1]
    assert got[50] == (50, 50)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 6)], "a long, b long")
    got = dict(graph.connected_components(spark.createDataFrame([(1,)], "node long"), edges).collect())
    assert got[1] == 1 and got[6] == 5 and {got[i] for i in range(100, 161)} == {100}


# ---- expressions ----
@pytest.mark.parametrize(("hl", "age", "want"), [(0.5, 0.0, 1.0), (0.5, 0.5, 0.525), (None, 3.0, 1.0), (0, 3.0, 1.0), (math.inf, 3.0, 1.0)])
def test_recency_edges(spark, hl, age, want):
    assert spark.range(1).select(S.recency_weight(F.lit(age), hl)).first()[0] == pytest.approx(want)


def test_partial_dates_and_scalars(spark):
    df = spark.createDataFrame([("2013",), ("2013-04",), ("2013-04-31",), (None,), ("2013-04-05",)], "t string")
    assert [str(r[0]) for r in df.select(S.whole_date("t")).collect()] == ["2013-01-01", "2013-04-01", "None", "None", "2013-04-05"]
    one = spark.range(1)
    assert one.select(S.trigram_similarity(F.lit("word"), F.lit("word"))).first()[0] == 1.0
    assert one.select(S.trigram_similarity(F.lit("cat"), F.lit("hat"))).first()[0] == pytest.approx(1 / 7)
    assert one.select(S.novelty(F.lit(None).cast("int"))).first()[0] == 1.0
    assert [one.select(S.age_bucket(F.lit(y))).first()[0] for y in (-3.0, 1.9, 2.0, 10.0, 25.0)] == [0, 0, 1, 3, 4]
    assert one.select(S.spread_of_counts(F.create_map(F.lit("1"), F.lit(50), F.lit("3"), F.lit(50)))).first()[0] == pytest.approx(1.0)
    assert one.select(S.merged_maps(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))).first()[0] == {"a": 2}


def test_sql_functions(spark):
    S.register_functions(spark)
    assert tuple(spark.sql("select format_class('OVA'), format_class(null), recency_weight(0.5D, 0.5D, 0.05D), novelty(0)").first()) == ("side", "main", pytest.approx(0.525), 1.0)


def test_age_fair_popularity(spark):
    df = spark.createDataFrame(
        [(1, 563, "2020-01-01"), (2, 100, "1990-01-01"), (3, None, None), (4, 100, "2021-01-01")], "item_id long, members long, d string"
    ).withColumn("start_date", F.to_date("d"))
    got = dict(df.select("item_id", S.grown_members("members", "start_date", F.lit("2021-01-01").cast("date"))).collect())
    assert got[2] == 100 and got[3] == 0 and got[4] == pytest.approx(500) and got[1] == pytest.approx(1000, rel=0.01)


# ---- merges ----
def test_a_stub_loses_nothing(spark):
    schema = "item_id long, title string, mean double, genres array<string>"
    stored = spark.createDataFrame([(1, "a", 7.0, ["x"])], schema)
    new = spark.createDataFrame([(1, "b", None, []), (1, None, None, None), (2, "c", None, [])], schema)
    assert sorted((r.item_id, r.title, r.mean, r.genres) for r in merge.coalescing_upsert(stored, new, "item_id").collect()) == [(1, "b", 7.0, ["x"]), (2, "c", None, [])]


def test_a_broken_off_fetch_does_not_wipe_a_list(spark):
    schema = "user_id long, item_id long, score int"
    stored = spark.createDataFrame([(1, i, 5) for i in range(30)] + [(2, i, 5) for i in range(5)], schema)
    new = spark.createDataFrame([(1, 0, 6), (2, 9, 6)], schema)
    table, refused = merge.replace_lists(stored, new)
    assert rows(refused) == [(1,)] and table.filter("user_id = 1").count() == 30 and rows(table.filter("user_id = 2")) == [(2, 9, 6)]


def test_changes_are_logged_once(spark):
    schema = "user_id long, item_id long, status string, score int"
    old = spark.createDataFrame([(1, 1, "completed", 8), (1, 2, "watching", 0), (1, 3, "dropped", 2)], schema)
    new = spark.createDataFrame([(1, 1, "completed", 8), (1, 2, "completed", 9), (1, 4, "watching", 0)], schema)
    got = merge.list_changes(old, new, F.lit(datetime(2024, 1, 1))).select("item_id", "status", "score")
    assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == [(2, "completed", 9), (3, "", 0), (4, "watching", 0)]


def test_a_unique_id_moves(spark):
    stored = spark.createDataFrame([(1, 100), (2, None), (3, 300)], "item_id long, media_id long")
    assert rows(merge.exclusive_update(stored, spark.createDataFrame([(2, 100)], "item_id long, media_id long"), "item_id", "media_id").fillna(0)) == [(1, 0), (2, 100), (3, 300)]


# ---- population ----
def tribes(spark):
    rng, out = np.random.default_rng(3), []
    for u in range(120):
        a, b = (range(20), range(20, 40)) if u % 2 == 0 else (range(20, 40), range(20))
        out += [(u, int(1000 + i), float(rng.integers(8, 11))) for i in rng.choice(list(a), 14, replace=False)]
        out += [(u, int(1000 + i), float(rng.integers(3, 6))) for i in rng.choice(list(b), 8, replace=False)]
    return spark.createDataFrame(out, "user_id long, item_id long, score double")


def test_two_tribes(spark):
    ratings = tribes(spark)
    bias, res = population.residuals(ratings, 5)
    sims = population.item_neighbours(res, 5.0, 15)
    me = spark.createDataFrame([(500, 1000 + i, 9.0) for i in range(4)] + [(500, 1030, 4.0)], "user_id long, item_id long, score double")
    pairs = spark.createDataFrame([(500, 1000 + i) for i in range(4, 40)], "user_id long, item_id long")
    position = population.rated_deviations(me, bias)
    knn = {r.item_id: r.knn for r in population.neighbour_signal(pairs, position, sims).collect()}
    assert np.mean([knn.get(1000 + i, 0) for i in range(4, 20)]) > np.mean([knn.get(1000 + i, 0) for i in range(20, 40)]) + 0.3
    v = population.factors(res, 4, 1.0, 4)
    mf = {r.item_id: r.mf for r in population.factor_signal(pairs, population.fold_in(position, v, 4, 1.0), v).collect()}
    assert np.mean([mf[1000 + i] for i in range(4, 20)]) > np.mean([mf[1000 + i] for i in range(20, 40)])


def test_blocked_pairs_equal_the_plain_join(spark):
    _, res = population.residuals(tribes(spark), 5)
    plain, blocked = (sorted((r.i, r.j, round(r.dot, 9), r.co) for r in population._pairs(res, "e", n).collect()) for n in (2_000, 5))
    assert plain == blocked


def test_closed_form_model_against_numpy(spark):
    ratings = tribes(spark)
    got = population.item_item_model(ratings, 20.0, 5, None, 100, block=16).toPandas()
    x = np.zeros((120, 40))
    for r in ratings.collect():
        x[r.user_id, r.item_id - 1000] = 1
    p = np.linalg.inv(x.T @ x + 20 * np.eye(40))
    w = -p / np.diag(p)[None, :]
    assert len(got) > 1000
    for r in got.sample(200, random_state=1).itertuples():
        assert r.weight == pytest.approx(w[r.other_id - 1000, r.item_id - 1000], abs=1e-9)


def test_stacker_is_plain_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = x @ [1.5, -0.5] + 0.3 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    coef = {r.feature: r.coef for r in population.fit_stacker(df, ("a", "b"), "y", 5.0).collect()}
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc)
    assert [coef["a"], coef["b"]] == pytest.approx(want.tolist(), abs=1e-6)


# ---- users, ranking ----
def test_one_decomposition_serves_every_penalty():
    rng = np.random.default_rng(1)
    x, w = (rng.random((60, 8)) < 0.3).astype(float), rng.random(60) + 0.2
    y = x @ rng.normal(size=8) + rng.normal(size=60)
    best, losses = usermodel.choose_alpha(x, y, w), []
    of = np.arange(60) * 7919 % 60 % 10
    for alpha in usermodel.ALPHAS:
        loss = 0.0
        for k in range(10):
            coef, b = usermodel.ridge(x[of != k], y[of != k], w[of != k], alpha)
            loss += (w[of == k] * (y[of == k] - x[of == k] @ coef - b) ** 2).sum()
        losses.append(loss)
    assert best == usermodel.ALPHAS[int(np.argmin(losses))]


def test_calibrated_choice_follows_the_profile():
    keys = np.array([1.0, 0.99, 0.98, 0.5])
    traits = np.array([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    aim = np.array([0.5, 0.5])
    assert 3 in rerank.greedy(keys, 0.3, [rerank.Balance(aim, traits, 0.7)], 2)
    assert rerank.greedy(keys, 1.0, [rerank.Balance(aim, traits, 0.0)], 2) == [0, 1]
    assert rerank.in_blocks([3, 0, 2, 1], 2) == [0, 3, 1, 2] and rerank.in_blocks([3, 0, 2, 1], 0) == [0, 1, 2, 3]


def test_calibrated_choice_equals_plain_divergence():
    """Each pick is the best trade, worked out from the divergence itself."""
    rng = np.random.default_rng(2)
    keys, traits, aim = rng.random(30), rng.dirichlet(np.ones(4), 30), np.array([0.1, 0.2, 0.0, 0.7])
    worth = (keys - keys.min()) / (keys.max() - keys.min() + 1e-9)

    def plain(rows):
        q = 0.01 * aim + 0.99 * traits[rows].sum(0) / traits[rows].sum()
        return 0.4 * worth[rows].sum() - 0.6 * sum(a * np.log(a / b) for a, b in zip(aim, q, strict=True) if a > 0)

    picked = []
    for _ in range(8):
        rest = [r for r in range(30) if r not in picked]
        picked.append(max(rest, key=lambda r: plain([*picked, r])))
    assert rerank.greedy(keys, 0.4, [rerank.Balance(aim, traits, 0.6)], 8) == picked


def test_unfiltered_read_is_the_stored_list(spark):
    rows_ = [(1, i, i % 5, float(10 - i), 7.0 + i % 3, 100 * (i + 1), ["a", "b"] if i % 2 else ["c"]) for i in range(12)]
    df = spark.createDataFrame(rows_, "user_id long, item_id long, franchise_id long, key double, prediction double, popularity int, genres array<string>")
    built = rerank.rerank(df, Settings(), 4)
    none = df.select("user_id", "item_id").limit(0)
    again = rerank.read_list(rerank.with_novelty(df, Settings()).drop("value", "novelty"), none, F.lit(True), Settings(), 4)
    assert [(r.item_id, r.position) for r in built.orderBy("position").collect()] == [(r.item_id, r.position) for r in again.orderBy("position").collect()]


def test_reader_filter(spark):
    df = spark.createDataFrame([(1, "tv", 12, 2000, ["a"]), (2, "movie", 1, 2000, ["b"]), (3, "tv", 0, 2001, ["a", "x"]), (4, "tv", 30, 2005, None)], "item_id int, media_type string, num_episodes int, season_year int, genres array<string>")
    assert [r[0] for r in df.filter(candidates.keep_filter((), (5, 26), (None, None), ("x",))).select("item_id").collect()] == [1, 2]


# ---- statistics ----
@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=12), st.data())
def test_spearman_property(spark, a, data):
    b = data.draw(st.lists(st.integers(0, 6), min_size=len(a), max_size=len(a)))
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, b, strict=True)], "user_id long, prediction double, truth double")
    ranks = lambda v: np.array([sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v])
    ra, rb = ranks(a), ranks(b)
    want = 0.0 if ra.std() == 0 or rb.std() == 0 else np.corrcoef(ra, rb)[0, 1]
    assert evaluate.spearman(df).first()["rho"] == pytest.approx(want, abs=1e-9)


def test_step_up_and_step_down(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.9]
    df = spark.createDataFrame([("f", f"t{k}", x) for k, x in enumerate(p)], "family string, name string, p double")
    assert [r.keep for r in evaluate.benjamini_hochberg(df, 0.05).orderBy("p").collect()] == [True, True, True, True, False]
    assert [r.keep for r in evaluate.holm(df, 0.05).orderBy("p").collect()] == [True, False, False, False, False]


def test_likely_set_and_tails(spark):
    q = [float(x) for x in np.linspace(-1, 1, 21)]
    r = evaluate.likely_ratings(spark.createDataFrame([(8.2, q)], "prediction double, q array<double>")).first()
    assert (r.low, r.high) == (8, 8) and r.p_high == pytest.approx(0.35)
    assert evaluate.student_tail(np.array([2.0, 12.7062]), np.array([10.0, 1.0])) == pytest.approx([0.036694, 0.025], abs=1e-5)
    assert spark.range(1).select(evaluate.normal_tail(F.lit(1.959964))).first()[0] == pytest.approx(0.025, abs=1e-7)
    assert spark.range(1).select(evaluate.normal_tail(F.lit(4.0))).first()[0] == pytest.approx(3.1671e-5, rel=1e-3)


def test_franchise_affinity_leaves_the_title_out(spark):
    dev = spark.createDataFrame([(1, 10, 2.0, 1.0), (1, 11, 0.5, 1.0)], "user_id long, item_id long, d double, w double")
    f = spark.createDataFrame([(10, 10), (11, 10), (12, 10)], "item_id long, franchise_id long")
    assert rows(affinity.franchise_affinity(dev, f)) == [(1, 10, 0.5, True), (1, 11, 2.0, True), (1, 12, 2.0, True)]
