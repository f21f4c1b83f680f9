"""Affinities of the asked pairs only, and of whole franchises without a shuffle of what they make."""

import pytest
from pyspark.sql import functions as F

from palate.operators import affinity


@pytest.fixture
def world(spark):
    dev = spark.createDataFrame([(u, i, float((u * 5 + i * 3) % 7 - 3), 0.5 + i % 2) for u in range(12) for i in range(30) if (u * i + i) % 4 == 1], "user_id long, item_id long, d double, w double")
    edges = spark.createDataFrame([(s, t, 1.0 / (1 + (s + t) % 5)) for s in range(30) for t in range(30) if s != t and (s * t) % 6 < 2], "src long, dst long, weight double")
    franchise = spark.createDataFrame([(i, i % 4) for i in range(30)], "item_id long, franchise_id long")
    pairs = spark.createDataFrame([(u, i) for u in (2, 4, 99) for i in (0, 5, 9, 27, 29)], "user_id long, item_id long")
    return dev, edges, franchise, pairs


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_rec_affinity_is_the_plain_sum(world):
    dev, edges, _, pairs = world
    mass = F.sum(F.col("weight") * F.col("w"))
    plain = dev.join(edges, dev.item_id == edges.dst).groupBy("user_id", F.col("src").alias("item_id")).agg((F.sum(F.col("weight") * F.col("w") * F.col("d")) / (mass + 1.5)).alias("a"), F.count("*").alias("n"))
    assert _rows(affinity.rec_affinity(dev, edges)) == _rows(plain)
    assert _rows(affinity.rec_affinity(dev, edges, pairs=pairs)) == _rows(plain.join(pairs, ["user_id", "item_id"], "left_semi"))


def test_rec_affinity_shuffles_no_product(world):
    dev, edges, _, _ = world
    plan = affinity.rec_affinity(dev, edges)._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(__range" in plan and "Exchange hashpartitioning(user_id" not in plan


def test_franchise_affinity_of_pairs_and_of_large_catalogues(world, monkeypatch):
    dev, _, franchise, pairs = world
    every = _rows(affinity.franchise_affinity(dev, franchise))
    asked = set(map(tuple, pairs.collect()))
    assert _rows(affinity.franchise_affinity(dev, franchise, pairs)) == [r for r in every if r[:2] in asked] != []
    monkeypatch.setattr(affinity, "FRANCHISE_BROADCAST", 0)
    assert _rows(affinity.franchise_affinity(dev, franchise)) == every


def test_titles_of_a_franchise_are_laid_out_in_place(world):
    dev, _, franchise, _ = world
    plan = affinity.franchise_affinity(dev, franchise)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "BroadcastExchange" in plan
