"""Statements, slices and batches; ages, people and optional columns of a user; keys of lists: against plain Python on fixed and drawn cases."""

from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.operators import affinity, candidates, usermodel
from palate.settings import Settings, deployed
from palate.sources import scan

ENTRY = "user_id long, item_id long, score int, status string, rated_at timestamp"


def test_statement_takes_values_as_values(spark):
    people = spark.createDataFrame([(1, "a"), (2, "' OR 1 = 1 --")], "id long, name string")
    ask = lambda name: [r.id for r in scan.statement(spark, "SELECT id FROM {people} WHERE name = :name", {"name": name}, people=people).collect()]
    assert ask("a") == [1] and ask("' OR 1 = 1 --") == [2] and ask("x' OR 'a' = 'a") == []


def test_filters_of_a_statement_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = scan.statement(spark, "SELECT o_orderkey FROM {orders} WHERE o_custkey = :user", {"user": 7}, orders=orders)._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_batches_cover_every_row_once_and_go_on(spark):
    rows = spark.range(1003).select((F.col("id") * 7919 % 1003).alias("k"), F.lit("x").alias("batch_of"))
    got = scan.batched(rows, 100, "k")
    by = {r.batch: (r.n, r.low, r.high) for r in got.groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()}
    assert by == {b: (100 if b < 10 else 3, 100 * b, min(100 * b + 99, 1002)) for b in range(11)}
    assert scan.batches_after(got, 7).count() == 203 and scan.batches_after(got, None).count() == 1003 and scan.batched(rows.limit(0), 5, "k").count() == 0
    with pytest.raises(ValueError):
        scan.batched(rows, 0, "k")


def test_user_slice(spark):
    rows = spark.createDataFrame([(u, i, i % 3, "completed", None) for u in range(6) for i in range(u * 3)] + [(None, 1, 5, "completed", None)], ENTRY)
    users = lambda **k: sorted({r.user_id for r in scan.user_slice(rows, **k).collect()})
    assert users(low=2, high=4) == [2, 3, 4] and users(low=4) == [4, 5] and users(low=1, least_scored=6) == [3, 4, 5]
    assert scan.user_slice(rows).count() == rows.count() and users(low=9) == []


def test_watched_ages_equal_a_plain_count(spark):
    rng = np.random.default_rng(5)
    years = {i: int(rng.integers(1960, 2003)) if i % 6 else None for i in range(60)}
    stored = {i: 1990 for i in range(0, 60, 12)}
    rows = [(int(u), int(i), 0, ["completed", "plan_to_watch", "dropped"][int(rng.integers(3))], None if rng.random() < 0.1 else datetime(int(rng.integers(1995, 2003)), 3, 1)) for u in range(8) for i in rng.choice(60, int(rng.integers(5, 50)), replace=False)]
    want = {}
    for u in {r[0] for r in rows}:
        ages = [r[4].year - (years[r[1]] or stored.get(r[1])) for r in rows if r[0] == u and r[3] != "plan_to_watch" and r[4] and (years[r[1]] or stored.get(r[1]))]
        want[u] = None if len(ages) < 10 else [float(x) for x in np.bincount(np.searchsorted([2, 5, 10, 20], np.maximum(ages, 0), side="right"), minlength=5) / len(ages)]
    got = affinity.watched_age_mix(spark.createDataFrame(rows, ENTRY), spark.createDataFrame(list(years.items()), "item_id long, season_year int"), spark.createDataFrame(list(stored.items()) * 2, "item_id long, season_year int"))
    got = {r.user_id: r.mix for r in got.collect()}
    assert got.keys() == want.keys() and any(v is None for v in want.values()) and any(want.values())
    for u, mix in want.items():
        assert got[u] is None if mix is None else got[u] == pytest.approx(mix)


def test_age_aim(spark):
    mixes = spark.createDataFrame([(1, [0.5, 0.5, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0, 0.0]), (3, None)], "user_id int, mix array<double>")
    aim = lambda w: {r.user_id: r.m for r in mixes.select("user_id", affinity.age_aim("mix", w).alias("m")).collect()}
    assert aim(0.5)[1] == pytest.approx([1 / 3, 2 / 3, 0, 0, 0]) and aim(1.0)[1] == pytest.approx([0.5, 0.5, 0, 0, 0])
    assert aim(0.0) == {1: [0.0, 1.0, 0.0, 0.0, 0.0], 2: [1.0, 0.0, 0.0, 0.0, 0.0], 3: None}


def test_staff_affinity_equals_pairs_of_titles(spark):
    rng = np.random.default_rng(9)
    staff = sorted({(int(rng.integers(40)), int(rng.integers(12))) for _ in range(150)})
    dev = [(u, int(i), float(rng.normal()), float(rng.random())) for u in range(6) for i in rng.choice(40, 15, replace=False)]
    pairs = [(u, i) for u in range(7) for i in range(0, 40, 3)]
    of = defaultdict(set)
    for i, p in staff:
        of[i].add(p)
    want = {}
    for u, i in pairs:
        near = [(d, w) for v, j, d, w in dev if v == u and j != i and of[i] & of[j]]
        if near:
            want[u, i] = (sum(d * w for d, w in near) / (sum(w for _, w in near) + 2), len(near))
    s, d, p = spark.createDataFrame(staff * 2, "item_id long, staff_id long"), spark.createDataFrame(dev, "user_id long, item_id long, d double, w double"), spark.createDataFrame(pairs * 2, "user_id long, item_id long")
    got = {(r.user_id, r.item_id): (r.signal, r.n) for r in affinity.staff_affinity(p, d, s).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    rows = usermodel.user_rows(p.withColumn("title", F.lit("own")), s.select("item_id").distinct().withColumn("title", F.lit("t")), None, affinity.staff_affinity(p, d, s)).collect()
    assert len(rows) == sum(bool(of[i]) for _, i in pairs) and {r.title for r in rows} == {"t"} and {r.tag_cosine for r in rows} == {0.0}
    assert all(r.staff_aff == pytest.approx(want.get((r.user_id, r.item_id), (0.0,))[0]) for r in rows)


def test_optional_columns(spark):
    items = spark.createDataFrame([(1, 0.04, 1.78), (2, None, None)], "item_id long, drop_rate double, score_sd double")
    every = Settings(content_audience=True, content_staff=True, level_trend="log")
    assert usermodel.extra_columns(Settings()) == () and usermodel.extra_columns(every) == ("drop_c", "polar_c", "staff_aff", "age_y")
    got = {(r.item_id, r.feature): r.value for r in usermodel.audience_extras(items, every).collect()}
    assert got == {(1, "x:drop_c"): pytest.approx((np.log10(0.05) + 1.27) / 0.4), (1, "x:polar_c"): 0.0, (2, "x:drop_c"): 0.0, (2, "x:polar_c"): 0.0}
    assert usermodel.audience_extras(items, Settings()).collect() == []


def test_keys_of_lists():
    s = Settings(safe_bets_risk=0.25, discover_ranker_weight=0.5)
    assert usermodel.surface_key("safe_bets", s) == {"popularity_prior": 0.5, "risk_scale": 0.25}
    assert usermodel.surface_key("discover", s) == usermodel.surface_key("hidden_gems", s) == {"popularity_prior": 0.0, "risk_scale": 1.0}
    assert usermodel.enabled_surfaces(s) == ("discover",) and usermodel.enabled_surfaces(deployed()) == ("safe_bets", "discover", "hidden_gems")


def test_titles_left_to_a_list(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, item_id long")
    saved = spark.createDataFrame([(1, "next_up", 1), (1, "discover", 2), (3, "next_up", 1)], "user_id long, surface string, item_id long")
    assert sorted(map(tuple, candidates.left_to(pairs, saved, "next_up").collect())) == [(1, 2), (2, 1)]
