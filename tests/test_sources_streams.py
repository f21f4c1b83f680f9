import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palate.operators import logs
from palate.sources import payloads
from palate.streaming import drain
from palate.streaming import logs as stream_logs

T = datetime


def test_item_payloads(spark, tmp_path):
    node = {
        "id": 5, "title": "a", "media_type": "tv", "start_date": "2013-04", "num_episodes": 0, "genres": [{"id": 1, "name": "x"}], "statistics": {"status": {"dropped": "10", "completed": "90"}, "num_list_users": 100},
        "recommendations": [{"node": {"id": 6, "title": "b"}, "num_recommendations": 4}, {"node": {"id": 7, "title": "c"}, "num_recommendations": 0}], "related_anime": [{"node": {"id": 8, "title": "d"}, "relation_type": "sequel"}],
    }
    (tmp_path / "n.json").write_text(json.dumps(node))
    nodes = payloads.read_nodes(spark, str(tmp_path / "n.json"))
    item = payloads.item_rows(nodes).first()
    assert (item.item_id, str(item.start_date), item.num_episodes, item.genres, item.drop_rate) == (5, "2013-04-01", None, ["x"], pytest.approx(0.1))
    assert [tuple(r) for r in payloads.edge_rows(nodes).collect()] == [(5, 6, "first", 4, pytest.approx(2.0))]
    assert [tuple(r) for r in payloads.relation_rows(nodes).collect()] == [(5, 8, "sequel", "first")]
    assert sorted(r.item_id for r in payloads.stub_rows(nodes).collect()) == [6, 7, 8]


def test_media_payloads(spark, tmp_path):
    media = {
        "id": 1, "idMal": 5, "averageScore": 80, "tags": [{"name": "t", "rank": 60, "isAdult": False}, {"name": "weak", "rank": 10, "isAdult": False}, {"name": "no", "rank": 90, "isAdult": True}],
        "staff": {"edges": [{"role": "Director (eps 1-3)", "node": {"id": 9}}, {"role": "Key Animation", "node": {"id": 10}}]}, "stats": {"scoreDistribution": [{"score": 10, "amount": 50}, {"score": 30, "amount": 50}], "statusDistribution": [{"status": "DROPPED", "amount": 30}, {"status": "COMPLETED", "amount": 70}]},
    }
    (tmp_path / "m.json").write_text(json.dumps(media))
    rows = payloads.read_media(spark, str(tmp_path / "m.json"))
    one = payloads.media_rows(rows).first()
    assert one.score_sd == pytest.approx(10) and one.drop_rate == pytest.approx(0.3)
    assert [tuple(r) for r in payloads.tag_rows(rows).collect()] == [(5, "t", 60)]
    assert [tuple(r) for r in payloads.staff_rows(rows).collect()] == [(5, 9, "Director")]


def test_outcome_truth_table(spark):
    cases = [("plan_to_watch", 0, True, False), ("watching", 0, True, False), ("completed", 9, True, False), ("completed", 5, False, True), ("dropped", 0, False, True)]
    entries = [(u, 1, s, c, T(2024, 1, 5)) for u, (s, c, _, _) in enumerate(cases)]
    entries += [(u, 100, "completed", 8, T(2023, 1, 1)) for u in range(6)] + [(2, 101, "completed", 7, T(2023, 1, 1)), (3, 101, "completed", 11, T(2023, 1, 1))]
    log = [(u, "safe", 1, 1, 8.0, T(2024, 1, 1)) for u in range(6)]
    feedback = [(5, 1, "not_interested", T(2024, 1, 2))]
    out = logs.outcomes(
        spark.createDataFrame(log, "user_id long, surface string, item_id long, rank int, predicted double, shown_at timestamp"), spark.createDataFrame(entries, "user_id long, item_id long, status string, score int, rated_at timestamp"),
        spark.createDataFrame(feedback, "user_id long, item_id long, action string, created_at timestamp"), ("safe",),
    )
    got = {r.user_id: (r.positive, r.negative) for r in out.collect()}
    assert {u: got[u] for u in range(5)} == {u: (p, n) for u, (_, _, p, n) in enumerate(cases)} and got[5] == (False, True)


def _stream(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_change_stream(spark, tmp_path):
    schema = "user_id long, item_id long, status string, score int, at timestamp"
    rows = [(1, 1, "watching", 0, T(2024, 1, 1)), (1, 1, "watching", 0, T(2024, 1, 2)), (1, 1, "completed", 9, T(2024, 1, 3)), (1, 1, None, None, T(2024, 1, 4))]
    got = drain.drained(stream_logs.list_changes(_stream(spark, tmp_path, [rows], schema)))
    assert [(r.status, r.score) for r in got.orderBy("at").collect()] == [("watching", 0), ("completed", 9), (None, 0)]


def test_usage_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, item_id long"
    rows = [(k, T(2024, 1, 1 + k % 3, k % 24), k % 2, "view", 1.0, 1) for k in range(30)]
    out = drain.drained(stream_logs.daily_usage(_stream(spark, tmp_path, [rows[:15], rows[15:]], schema), "10 days"), "update")
    got = sorted(tuple(r) for r in drain.newest_update(out, "user_id", "kind", "day").select("user_id", "day", "n").collect())
    want = logs.daily_usage(spark.createDataFrame(rows, schema)).groupBy("user_id", "day").agg(F.sum("n"))
    assert got == sorted(tuple(r) for r in want.collect())


def test_lists_come_whole_or_not_at_all(spark, tmp_path):
    entry = lambda k: {"node": {"id": k, "title": "t"}, "list_status": {"status": "completed", "score": k % 10, "num_episodes_watched": 1, "finish_date": "2013-04", "updated_at": "2014-01-01T00:00:00"}}
    page = lambda user, n, more, **other: {"user_id": user, "page": n, "data": [entry(10 * n + 1)], "paging": {"next": "more"} if more else {}, **other}
    pages = [page(1, 0, True), page(1, 1, False), page(1, 1, False), page(2, 0, True), page(2, 1, False, error="504"), page(3, 0, True), page(3, 2, False), page(4, 0, True), page(5, 0, False), page(6, 1, False)]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, pages)))
    lists = payloads.read_lists(spark, str(tmp_path / "l.json"))
    rows = payloads.list_rows(payloads.whole_lists(lists)).collect()
    assert sorted((r.user_id, r.item_id, r.score) for r in rows) == [(1, 1, 1), (1, 11, 1), (5, 1, 1)]
    assert {str(r.rated_at) for r in rows} == {"2013-04-01 00:00:00"}
    assert payloads.whole_lists(lists.limit(0)).collect() == []
