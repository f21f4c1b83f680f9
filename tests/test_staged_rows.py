"""Rows that a learned order is fitted on and applied to are made once."""

from palate.plans import further_queries, more_queries, source_queries
from palate.operators import affinity, population
from palate.sources.projection import Tables

SF = "/root/testdata/sf0.001"


def test_boosted_order_reads_written_rows(spark):
    df = further_queries.boosted_order(Tables(spark, SF))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0


def test_relevance_asks_for_the_shown_titles_only(spark, monkeypatch):
    t, whole, asked = Tables(spark, SF), population.list_cooccurrence, []
    want = sorted((r.user_id, r.item_id, round(r.z, 6)) for r in more_queries.relevance(t).collect())

    def spied(entries, **how):
        asked.append(how.get("asked"))
        return whole(entries)

    monkeypatch.setattr(population, "list_cooccurrence", spied)
    assert sorted((r.user_id, r.item_id, round(r.z, 6)) for r in more_queries.relevance(t).collect()) == want
    assert asked[0] is not None


def test_rows_of_a_user_take_the_asked_users_ratings_only(spark, monkeypatch):
    t, whole, seen = Tables(spark, SF), affinity.staff_affinity, []
    monkeypatch.setattr(affinity, "staff_affinity", lambda pairs, dev, staff: seen.append(dev) or whole(pairs, dev, staff))
    assert source_queries.user_rows(t).count() > 0
    asked = {r.user_id for r in t.rec_log.select("user_id").distinct().collect()}
    assert {r.user_id for r in seen[0].select("user_id").distinct().collect()} <= asked
