"""Hanging groups in rounds against the same turns taken one by one."""

import random

import pytest

from palate.operators import graph

pytestmark = pytest.mark.filterwarnings("ignore")


def one_by_one(sizes: dict[int, int], links: set[tuple[int, int]]) -> dict[int, int]:
    """What each group ends in, turn by turn. A whole group is known by its smallest id."""
    size, where, open_ = dict(sizes), {g: g for g in sizes}, {frozenset(x) for x in links if x[0] != x[1]}
    rank = lambda g: (size[g], -g)
    joined = True
    while joined:
        joined = False
        turns = sorted({g for link in open_ for g in link}, key=rank)
        for t in turns:
            g = where[t]
            larger = {h for link in open_ if g in link for h in link if h != g and rank(h) > rank(g)}
            if not larger:
                continue
            open_ = {link for link in open_ if not (g in link and link & larger)}
            if len(larger) > 1 and size[g] > 1:
                continue
            h = max(larger, key=rank)
            low, high = sorted((g, h))
            size[low] = size[g] + size[h]
            del size[high]
            where = {k: low if v == high else v for k, v in where.items()}
            open_ = {frozenset(low if x == high else x for x in link) for link in open_}
            open_ = {link for link in open_ if len(link) == 2}
            joined = True
    return where


def random_graphs(count: int, seed: int):
    draw = random.Random(seed)
    for k in range(count):
        base = 1000 * k
        ids = draw.sample(range(1, 900), draw.randint(2, 14))
        top = draw.choice((1, 2, 6))  # many singles, many ties, or all sizes
        sizes = {base + i: draw.randint(1, top) for i in ids}
        names = list(sizes)
        links = {tuple(draw.sample(names, 2)) for _ in range(draw.randint(1, 2 * len(names)))}
        if draw.random() < 0.3:  # a hub
            links |= {(names[0], x) for x in names[1:]}
        yield sizes, links


def test_rounds_give_what_turns_one_by_one_give(spark):
    """1,000 random graphs side by side in one table."""
    sizes, links, want = {}, set(), {}
    for some, edges in random_graphs(1000, 7):
        sizes |= some
        links |= edges
        want |= one_by_one(some, edges)
    groups = spark.createDataFrame(list(sizes.items()), "group_id long, n long")
    got = dict(graph.hung(groups, spark.createDataFrame(list(links), "ga long, gb long")).collect())
    linked = {x for link in links for x in link}
    assert set(got) == linked
    assert {g for g in linked if got[g] != want[g]} == set()


def test_a_thousand_titles_hang_off_one_in_one_round(spark):
    groups = spark.createDataFrame([(5, 9)] + [(k, 1) for k in range(1000, 2000)], "group_id long, n long")
    links = spark.createDataFrame([(k, 5) for k in range(1000, 2000)], "ga long, gb long")
    assert {r["into"] for r in graph.hung(groups, links, max_rounds=3).collect()} == {5}


def test_no_links_and_links_within_a_group(spark):
    groups = spark.createDataFrame([(1, 2), (2, 1)], "group_id long, n long")
    assert graph.hung(groups, spark.createDataFrame([], "ga long, gb long")).collect() == []
    assert graph.hung(groups, spark.createDataFrame([(1, 1)], "ga long, gb long")).collect() == []
