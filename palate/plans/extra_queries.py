"""Driver queries over the registry, work selection, neighbours, digests and page reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import affinity, evaluate, logs, registry, rerank
from ..sources import merge
from ..sources.projection import AS_OF, Tables
from .more_queries import _TOP, _items, _toplist
from .oracle import oracle
from .queries import _EVAL, _FRANCHISE, _franchise, _pairs, query, r6


@query("agg12_series_weight", oracle("SELECT user_id, item_id, round(pow(count(*) OVER (PARTITION BY user_id, franchise_id), -0.5), 6) AS share FROM rated JOIN franchise USING (item_id)", "rated", franchise=_FRANCHISE))
def series_weight(t: Tables) -> DataFrame:
    return affinity.series_weight(t.rated, _franchise(t).withColumnRenamed("franchise_id", "series_id"), 0.5).select("user_id", "item_id", *r6("share"))


@query("agg14_score_spread", oracle("SELECT item_id, round(stddev_pop(score), 6) AS sd FROM rated GROUP BY 1 HAVING count(*) >= 10", "rated"))
def score_spread(t: Tables) -> DataFrame:
    dist = t.rated.groupBy("item_id", F.col("score").cast("string").alias("s")).agg(F.count("*").alias("n")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("dist"))  # ten scores
    return dist.select("item_id", F.round(S.spread_of_counts("dist", 10), 6).alias("sd")).filter("sd is not null")


@query("agg22_outcome_rates", oracle("SELECT after, round(avg(p), 6) AS positive, count(*) AS users FROM (SELECT user_id, shown_at >= TIMESTAMP '2024-01-12' AS after, avg(CAST(item_id % 3 = 0 AS INTEGER)) AS p FROM rec_log GROUP BY 1, 2) GROUP BY 1", "rec_log"))
def outcome_rates(t: Tables) -> DataFrame:
    rows = t.rec_log.select("user_id", (F.col("shown_at") >= F.lit("2024-01-12").cast("timestamp")).alias("after"), F.lit(True).alias("complete"), (F.col("item_id") % 3 == 0).alias("positive"), F.lit(False).alias("negative"))
    return logs.outcome_rates(rows).select("after", *r6("positive"), "users")


@query("agg23_feedback_summary", oracle("SELECT user_id, action, count(*) AS n, max(created_at) AS last_at FROM feedback GROUP BY 1, 2", "feedback"))
def feedback_summary(t: Tables) -> DataFrame:
    return logs.feedback_summary(t.feedback)


@query("agg28_status_counts", oracle("SELECT (SELECT count(*) FROM list_entry) AS entries, (SELECT count(DISTINCT user_id) FROM list_entry) AS users, (SELECT count(*) FROM item) AS titles, (SELECT count(*) FROM relation) AS links", "list_entry", "item", "relation"))
def status_counts(t: Tables) -> DataFrame:
    one = t.list_entry.agg(F.count("*").alias("entries"), F.count_distinct("user_id").alias("users"))
    return one.crossJoin(t.item.agg(F.count("*").alias("titles"))).crossJoin(t.relation.agg(F.count("*").alias("links")))  # one row each


@query("sel2_graph_targets", oracle("SELECT item_id, listed FROM (SELECT item.item_id, members IS NOT NULL AS listed, popularity FROM item LEFT JOIN item_stats USING (item_id) WHERE item.item_id % 4 <> 0) ORDER BY listed DESC, popularity ASC NULLS LAST, item_id LIMIT 100", "item", "item_stats"))
def graph_targets(t: Tables) -> DataFrame:
    return registry.graph_targets(_items(t).withColumn("fetched_at", F.when(F.col("item_id") % 4 == 0, F.lit(AS_OF))), t.list_entry, 100)


@query("pop13_roles", "SELECT c_custkey AS user_id, CAST(('0x' || substr(sha256('role|' || c_custkey), 1, 13)) AS BIGINT) / 4503599627370496.0 < 0.15 AS teaches FROM customer")
def roles(t: Tables) -> DataFrame:
    return t.read("customer").select(F.col("c_custkey").alias("user_id"), (S.unit_hash(F.lit("role"), "c_custkey") < 0.15).alias("teaches"))


@query("evl8_exam_users", "SELECT user_id FROM (SELECT DISTINCT o_custkey AS user_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey) ORDER BY CAST(('0x' || substr(sha256('exam|' || user_id), 1, 13)) AS BIGINT), user_id LIMIT 50")
def exam_users(t: Tables) -> DataFrame:
    return registry.exam_users(t.list_entry, 50)


@query("evl8_gate", oracle("SELECT 'rmse' AS metric, round(avg(n - o), 6) AS change, avg(n - o) >= -0.005 AS ok FROM (SELECT -sqrt(avg((truth - prediction) * (truth - prediction))) AS n, -sqrt(avg((truth - 5.5) * (truth - 5.5))) AS o FROM pairs GROUP BY user_id)", "rated", "item_stats", pairs=_EVAL))
def fit_gate(t: Tables) -> DataFrame:
    p = _pairs(t)
    new = evaluate.error(p).select("user_id", (-F.col("rmse")).alias("rmse"))
    old = evaluate.error(p.withColumn("prediction", F.lit(5.5))).select("user_id", (-F.col("rmse")).alias("rmse"))
    return registry.gate(new, old, ("rmse",)).select("metric", *r6("change"), "ok")


@query("sta7_user_neighbours", oracle("""SELECT user_id, other_id, round(sim, 6) AS sim, co FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, other_id) AS k FROM (SELECT a.user_id AS user_id, b.user_id AS other_id, sum(a.c * b.c) / (any_value(a.norm) * any_value(b.norm)) * count(*) / (count(*) + 10.0) AS sim, count(*) AS co
    FROM c a JOIN c b ON a.item_id = b.item_id AND a.user_id <> b.user_id AND a.norm > 0 AND b.norm > 0 WHERE a.user_id % 50 = 0 GROUP BY 1, 2) WHERE sim > 0) WHERE k <= 10""", "rated", c="SELECT *, sqrt(sum(c * c) OVER (PARTITION BY user_id)) AS norm FROM (SELECT user_id, item_id, score - avg(score) OVER (PARTITION BY user_id) AS c FROM rated)"))
def user_neighbours(t: Tables) -> DataFrame:
    asked = t.rated.filter("user_id % 50 = 0").select("user_id").distinct()
    return registry.user_neighbours(t.rated, asked, 10).select("user_id", "other_id", *r6("sim"), "co")


@query("sta9_quality_words", oracle("SELECT user_id, CASE WHEN m >= 0.6 THEN 'very well' WHEN m >= 0.45 THEN 'well' WHEN m >= 0.3 THEN 'fairly' ELSE 'poorly' END AS words FROM (SELECT user_id, avg(score) / 10 AS m FROM rated GROUP BY 1)", "rated"))
def quality_words(t: Tables) -> DataFrame:
    return t.rated.groupBy("user_id").agg((F.avg("score") / 10).alias("m")).select("user_id", registry.quality_words("m").alias("words"))


@query("key2_memory_bonus", oracle("""SELECT user_id, item_id, round(greatest(-0.15, least(0.15, 0.5 * (CASE WHEN stddev_pop(mean) OVER p > 1e-9 THEN (mean - avg(mean) OVER p) / stddev_pop(mean) OVER p ELSE 0 END - CASE WHEN stddev_pop(score) OVER p > 1e-9 THEN (score - avg(score) OVER p) / stddev_pop(score) OVER p ELSE 0 END)
    * stddev_pop(score) OVER p)), 6) AS bonus FROM rated JOIN item_stats USING (item_id) WINDOW p AS (PARTITION BY user_id)""", "rated", "item_stats"))
def memory_bonus(t: Tables) -> DataFrame:
    rows = t.rated.select("user_id", "item_id", F.col("score").cast("double").alias("key")).join(t.item_stats.select("item_id", F.col("mean").alias("long_key")), "item_id")
    return registry.memory_bonus(rows).select("user_id", "item_id", *r6("bonus"))


@query("top6_undated_last", oracle("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN item_id % 5 <> 0 THEN start_date END, DATE '9999-01-01'), score DESC, item_id) AS rank FROM rated JOIN item USING (item_id)", "rated", "item"))
def undated_last(t: Tables) -> DataFrame:
    rows = t.rated.join(t.item.select("item_id", F.when(F.col("item_id") % 5 != 0, F.col("start_date")).alias("start_date")), "item_id").withColumn("after_score", F.col("score"))
    return registry.undated_last(rows).select("user_id", "item_id", "rank")


@query("top1_page", oracle("SELECT item_id, title FROM item LEFT JOIN item_stats USING (item_id) ORDER BY mean DESC NULLS LAST, item_id LIMIT 20 OFFSET 40", "item", "item_stats"))
def page(t: Tables) -> DataFrame:
    return _items(t).orderBy(F.desc_nulls_last("mean"), "item_id").offset(40).limit(20).select("item_id", "title")


@query("win14_block_order", oracle("SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY (position - 1) // 5, score, item_id) AS place FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS position FROM rated)", "rated"))
def block_order(t: Tables) -> DataFrame:
    return rerank.block_sorted(_toplist(t), 5, F.col("score")).select("user_id", "item_id", "place")


@query("cnd11_stored_list", oracle(f"SELECT user_id, surface, item_id, position FROM (SELECT user_id, 'safe_bets' AS surface, item_id, position FROM ({_TOP}) WHERE position <= 10 AND user_id % 2 = 1) UNION ALL SELECT user_id, 'safe_bets', item_id, position + 100 FROM ({_TOP}) WHERE position BETWEEN 5 AND 12 AND user_id % 2 = 0 UNION ALL SELECT user_id, 'discover', item_id, position FROM ({_TOP}) WHERE position <= 3", "rated"))
def stored_list(t: Tables) -> DataFrame:
    """Lists of odd users are built anew: what was stored of them goes, other users' and other surfaces' lists stay."""
    lists = _toplist(t).select("user_id", F.lit("safe_bets").alias("surface"), "item_id", "position")
    stored = lists.filter("position between 5 and 12").withColumn("position", F.col("position") + 100).unionByName(lists.filter("position <= 3").withColumn("surface", F.lit("discover")))
    return merge.saved_surface(stored, lists.filter("position <= 10 and user_id % 2 = 1"))


@query("snk20_accounts", "SELECT o_custkey AS stable_id, o_orderkey AS account_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def accounts(t: Tables) -> DataFrame:
    sessions = t.read("orders").select(F.col("o_custkey").alias("stable_id"), F.col("o_orderkey").alias("account_id"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderpriority").alias("name"))
    return registry.merged_accounts(sessions).select("stable_id", "account_id")


@query("snk17_insert_new", oracle("SELECT user_id, item_id, CASE WHEN item_id % 2 = 0 THEN score ELSE score + 100 END AS score FROM list_entry", "list_entry"))
def insert_new(t: Tables) -> DataFrame:
    arriving = t.list_entry.withColumn("score", F.col("score") + 100)
    return merge.insert_new(t.list_entry.filter("item_id % 2 = 0"), arriving, "user_id", "item_id").select("user_id", "item_id", "score")


@query("pop16_registry", "SELECT p_partkey AS id, p_type AS kind FROM part QUALIFY p_partkey % 97 = 5 OR row_number() OVER (PARTITION BY p_type, p_partkey % 97 = 5 ORDER BY p_size DESC, p_partkey DESC) <= 2")
def model_registry(t: Tables) -> DataFrame:
    models = t.read("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), (F.col("p_partkey") % 97 == 5).alias("active"), F.col("p_size").alias("made_at"))
    return registry.fallbacks_kept(models).select("id", "kind")


@query("agg21_evidence_lines")
def evidence_lines(t: Tables) -> DataFrame:
    series = _franchise(t).withColumnRenamed("franchise_id", "series_id")
    values = evaluate.taste_groups(t.rated, t.item, series)
    evidence = evaluate.group_evidence(values, t.rated.groupBy("user_id").agg(F.avg("score").alias("mu")), z_least=1.0, fdr=0.5)
    attributes = t.item.select("item_id", F.explode(F.transform("genres", lambda g: F.struct(F.lit("genre").alias("kind"), g.alias("name")))).alias("g")).select("item_id", "g.kind", "g.name")
    return registry.evidence_lines(t.rec_log.select("user_id", "item_id").distinct(), attributes, evidence)
