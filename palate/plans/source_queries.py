"""Driver queries over sources and sinks that came in parts: statements, slices, batches, pages of lists, second-source documents, ids
that change hands, preferences; and over what a stored user says of ages, people and optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import affinity, candidates, rerank, taste, text, usermodel
from ..settings import Settings, deployed
from ..sources import merge, payloads, scan, session
from ..sources.projection import Tables
from .more_queries import _toplist
from .oracle import oracle
from .queries import _dev, query, r6


# ---- scans ----
@query("src1_statement", oracle("SELECT user_id, count(*) AS n, round(avg(score), 6) AS mean FROM list_entry JOIN item USING (item_id) WHERE score >= 3 AND studio <> 'Brand#1' AND season_year BETWEEN 1970 AND 1995 GROUP BY 1", "list_entry", "item"))
def by_statement(t: Tables) -> DataFrame:
    sql = "SELECT user_id, count(*) AS n, round(avg(score), 6) AS mean FROM {entries} JOIN {items} USING (item_id) WHERE score >= :least AND studio <> :studio AND season_year BETWEEN :low AND :high GROUP BY user_id"
    return scan.statement(t.spark, sql, {"least": 3, "studio": "Brand#1", "low": 1970, "high": 1995}, entries=t.list_entry, items=t.item)


@query("src3_batches", oracle("SELECT CAST(k // 100 AS BIGINT) AS batch, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM ev) GROUP BY 1", "ev"))
def batches(t: Tables) -> DataFrame:
    """The events in batches of a hundred, oldest first, and what each of them spans."""
    return scan.batched(t.events.select("ts", "event_id"), 100, "ts", "event_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@query("src8_user_slice", oracle("SELECT user_id, item_id, score, status FROM list_entry WHERE user_id BETWEEN 40 AND 4000 AND user_id IN (SELECT user_id FROM rated GROUP BY 1 HAVING count(*) >= 20)", "rated"))
def user_slice(t: Tables) -> DataFrame:
    return scan.user_slice(t.list_entry, 40, 4000, 20).select("user_id", "item_id", "score", "status")


# ---- documents ----
@query("src9_list_pages", oracle("SELECT user_id, item_id, status, score, rated_at AS at_ts FROM list_entry WHERE user_id % 7 > 0 AND user_id % 11 > 0 AND (user_id % 5 > 0 OR user_id NOT IN (SELECT user_id FROM list_entry GROUP BY 1 HAVING count(*) > 20))", "list_entry"))
def list_pages(t: Tables) -> DataFrame:
    """Lists as pages of ten in the service's JSON. One user in seven has no last page, one in eleven an error on the first, one in five
    lacks the third page where there is one: these keep what they have."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("item_id")) - 1
    rows = t.list_entry.withColumn("page", F.floor(place / 10).cast("int"))
    node = F.struct(F.struct(F.col("item_id").alias("id"), F.lit("t").alias("title")).alias("node"), F.struct("status", "score", F.lit(1).alias("num_episodes_watched"), F.date_format("rated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at")).alias("list_status"))
    pages = rows.groupBy("user_id", "page").agg(F.collect_list(node).alias("data"))  # ten entries
    last = F.max("page").over(Window.partitionBy("user_id"))
    more = (F.col("page") < last) | (F.col("user_id") % 7 == 0)
    pages = pages.withColumn("paging", F.struct(F.when(more, "next").alias("next"))).withColumn("error", F.when((F.col("user_id") % 11 == 0) & (F.col("page") == 0), "504"))
    raw = pages.filter("not (user_id % 5 = 0 and page = 2)").select(F.to_json(F.struct("user_id", "page", "error", "paging", "data")).alias("j"))
    lists = raw.select(F.from_json("j", payloads.LIST_ROW).alias("l")).select("l.*")
    return payloads.list_rows(payloads.whole_lists(lists)).select("user_id", "item_id", "status", "score", F.col("rated_at").alias("at_ts"))


def _media(t: Tables) -> DataFrame:
    """Second-source documents of all titles, in the service's JSON: opinions from the lists, tags from the titles' words, people with
    roles, some of them with a remark in brackets."""
    entry = lambda name, value, n: F.transform(F.array_sort(F.collect_list(F.struct(value.alias("of"), n.alias("n")))), lambda x: F.struct(x["of"].alias(name), x["n"].alias("amount")))
    scores = t.rated.groupBy("item_id", (F.col("score") * 10).alias("s")).agg(F.count("*").alias("n")).groupBy("item_id").agg(entry("score", F.col("s"), F.col("n")).alias("scoreDistribution"))
    status = F.when(F.col("status") == "on_hold", "PAUSED").when(F.col("status") == "plan_to_watch", "PLANNING").otherwise(F.upper("status"))
    states = t.list_entry.groupBy("item_id", status.alias("s")).agg(F.count("*").alias("n")).groupBy("item_id").agg(entry("status", F.col("s"), F.col("n")).alias("statusDistribution"))
    role = F.when(F.col("staff_id") % 3 == 0, "Director (eps 1-4)").when(F.col("staff_id") % 3 == 1, "Music").otherwise("Key Animation")
    people = t.item_staff.groupBy("item_id").agg(F.collect_list(F.struct(role.alias("role"), F.struct(F.col("staff_id").alias("id")).alias("node"))).alias("edges"))  # one title's people
    tags = F.transform("genres", lambda g: F.struct(g.alias("name"), ((F.length(g) * 17 + F.col("item_id")) % 101).cast("int").alias("rank"), (F.length(g) % 5 == 0).alias("isAdult")))
    rows = t.item.join(scores, "item_id", "left").join(states, "item_id", "left").join(people, "item_id", "left")
    doc = F.struct((F.col("item_id") * 10).alias("id"), F.col("item_id").alias("idMal"), F.lit(70).alias("averageScore"), F.lit(5).alias("favourites"), tags.alias("tags"), F.struct("edges").alias("staff"), F.struct("scoreDistribution", "statusDistribution").alias("stats"))
    return rows.select(F.from_json(F.to_json(doc), payloads.MEDIA).alias("m")).select("m.*")


@query("src12_media_rows", oracle("""SELECT item_id, item_id * 10 AS media_id, sd AS score_sd, CASE WHEN started >= 20 THEN round(dropped / started, 6) END AS drop_rate FROM item
    LEFT JOIN (SELECT item_id, CASE WHEN count(*) >= 50 THEN round(stddev_pop(score * 10), 4) END AS sd FROM rated GROUP BY 1) USING (item_id)
    LEFT JOIN (SELECT item_id, count(*) FILTER (WHERE status IN ('completed', 'dropped', 'on_hold')) AS started, count(*) FILTER (WHERE status = 'dropped') AS dropped FROM list_entry GROUP BY 1) USING (item_id)""", "rated", "item"))  # fmt: skip
def media_rows(t: Tables) -> DataFrame:
    return payloads.media_rows(_media(t), 20).select("item_id", "media_id", F.round("score_sd", 4).alias("score_sd"), *r6("drop_rate"))


@query("src13_staff_rows", oracle("SELECT item_id, staff_id, CASE staff_id % 3 WHEN 0 THEN 'Director' ELSE 'Music' END AS role FROM item_staff JOIN item USING (item_id) WHERE staff_id % 3 < 2", "item_staff", "item"))
def staff_rows(t: Tables) -> DataFrame:
    return payloads.staff_rows(_media(t))


@query("src14_tag_rows", oracle("SELECT DISTINCT item_id, tag, CAST((length(tag) * 17 + item_id) % 101 AS INTEGER) AS rank FROM (SELECT item_id, unnest(genres) AS tag FROM item) WHERE (length(tag) * 17 + item_id) % 101 >= 40 AND length(tag) % 5 > 0", "item"))
def tag_rows(t: Tables) -> DataFrame:
    return payloads.tag_rows(_media(t))


# ---- ids and preferences ----
@query("snk2_media_ids", oracle("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN item_id * 10 + 10 WHEN item_id % 5 = 1 AND item_id - 1 IN (SELECT item_id FROM item) THEN NULL ELSE item_id * 10 END AS media_id FROM item", "item"))
def media_ids(t: Tables) -> DataFrame:
    """Every fifth title gets the id that its neighbour had; the neighbour is left without."""
    stored = t.item.select("item_id", (F.col("item_id") * 10).alias("media_id"))
    return merge.exclusive_update(stored, t.item.filter("item_id % 5 = 0").select("item_id", (F.col("item_id") * 10 + 10).alias("media_id")), "item_id", "media_id")


@query("snk22_preferences", oracle("SELECT user_id, event_type AS name, coalesce(max(value) FILTER (WHERE event_id % 2 = 1), max(value)) AS value FROM ev GROUP BY 1, 2", "ev"))
def preferences(t: Tables) -> DataFrame:
    """Preferences of the events with even ids, then those of the others, which win."""
    side = lambda odd: t.events.filter(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(f"side{odd}"))  # noqa: E731  (five kinds)
    both = side(0).join(side(1), "user_id", "full")
    return both.select("user_id", F.explode(S.merged_maps("side0", "side1")).alias("name", "value"))


# ---- reads ----
_SHORT = "SELECT user_id, item_id, position, score FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS position FROM rated) WHERE position <= 40"


@query("top8_next_page", oracle("""SELECT user_id, item_id, CAST(k AS INTEGER) AS position FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, item_id) AS k FROM (
    SELECT user_id, item_id, score + 0.25 * least(1, log10(popularity) / 3.7) AS value FROM short JOIN item USING (item_id) JOIN item_stats USING (item_id) WHERE item_id % 7 > 0 AND season_year >= 1970)) WHERE k > 5 AND k <= 10""", "rated", "item", "item_stats", short=_SHORT))  # fmt: skip
def next_page(t: Tables) -> DataFrame:
    """The second page of five of a stored shortlist read with a filter, with novelty at work."""
    facts = t.item.select("item_id", "season_year", F.array().cast("array<string>").alias("genres"), F.col("item_id").alias("franchise_id")).join(t.item_stats.select("item_id", "popularity"), "item_id")
    shortlist = _toplist(t).filter("position <= 40").withColumn("key", F.col("score").cast("double")).withColumn("novelty_scale", F.lit(0.25)).join(facts, "item_id")
    page = rerank.read_list(shortlist, t.rated.filter("item_id % 7 = 0"), candidates.keep_filter(years=(1970, None)), Settings(), 5, offset=5)
    return page.select("user_id", "item_id", F.col("position").cast("int").alias("position"))


@query("cnd23_continuations", oracle(f"SELECT user_id, item_id FROM ({_SHORT}) s WHERE position > 5 AND NOT EXISTS (SELECT 1 FROM ({_SHORT}) n WHERE n.user_id = s.user_id AND n.item_id = s.item_id AND n.item_id % 3 = 0 AND n.position <= 20)", "rated"))
def continuations(t: Tables) -> DataFrame:
    """What the first list shows is left to it: the other lists do without exactly these titles, and keep what it stored but does not show."""
    short = _toplist(t).filter("position <= 40")
    surface = F.when((F.col("item_id") % 3 == 0) & (F.col("position") <= 20), "next_up").otherwise("discover")
    return candidates.left_to(short.filter("position > 5"), short.withColumn("surface", surface), "next_up").select("user_id", "item_id")


# ---- what a stored user says ----
_AGES = "CASE WHEN a < 2 THEN 0 WHEN a < 5 THEN 1 WHEN a < 10 THEN 2 WHEN a < 20 THEN 3 ELSE 4 END"


@query("cnd24_user_age_mix", oracle("SELECT user_id, " + ", ".join(f"round(c{k}{' * 0.5' if k == 0 else ''} / (n - c0 * 0.5), 6) AS b{k}" for k in range(5)) + " FROM (SELECT user_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE b = {k}) AS c{k}" for k in range(5)) + f" FROM (SELECT user_id, {_AGES} AS b FROM (SELECT user_id, year(rated_at) - CASE WHEN item_id % 4 = 0 THEN season_year + 1 ELSE season_year END AS a FROM list_entry JOIN item USING (item_id) WHERE list_entry.status <> 'plan_to_watch')) GROUP BY 1) WHERE n >= 10 AND n > c0 * 0.5", "list_entry", "item"))
def user_age_mix(t: Tables) -> DataFrame:
    """Ages at the time of watching; a title that the catalogue does not date takes the year that a shortlist stored. The share of new
    titles counts half in what a list is held to."""
    known = t.item.withColumn("season_year", F.when(F.col("item_id") % 4 > 0, F.col("season_year")))
    stored = t.item.filter("item_id % 4 = 0 or item_id % 4 = 1").select("item_id", (F.col("season_year") + 1).alias("season_year"))
    mix = affinity.watched_age_mix(t.list_entry, known, stored).filter("mix is not null").withColumn("mix", affinity.age_aim("mix", Settings().age_fresh_weight))
    return mix.select("user_id", *(F.round(F.col("mix")[k], 6).alias(f"b{k}") for k in range(5)))


@query("agg19_scale_words", oracle("SELECT user_id, CASE WHEN d >= 0.8 THEN 'much generous' WHEN d >= 0.3 THEN 'generous' WHEN d <= -0.8 THEN 'much strict' WHEN d <= -0.3 THEN 'strict' ELSE 'aligned' END AS word FROM (SELECT user_id, round(avg(score - mean), 6) AS d FROM rated JOIN item_stats USING (item_id) GROUP BY 1)", "rated", "item_stats"))
def scale_words(t: Tables) -> DataFrame:
    return taste.scale(t.rated, t.item_stats).select("user_id", taste.scale_words(F.round("diff", 6)).alias("word"))


@query("usr20_user_rows", oracle("""SELECT p.user_id, p.item_id, i.title, round(coalesce(signal, 0), 6) AS staff_aff, round(coalesce(cosine, 0), 4) AS tag_cosine FROM (SELECT DISTINCT user_id, item_id FROM rec_log) p JOIN item i ON i.item_id = p.item_id
    LEFT JOIN (SELECT user_id, item_id, sum(d * w) / (sum(w) + 2.0) AS signal FROM (SELECT DISTINCT p.user_id, p.item_id, w.item_id AS rated_id, w.w, w.score - m.mu AS d FROM (SELECT DISTINCT user_id, item_id FROM rec_log) p JOIN item_staff x ON x.item_id = p.item_id JOIN weighted w ON w.user_id = p.user_id AND w.item_id <> p.item_id
        JOIN item_staff y ON y.item_id = w.item_id AND y.staff_id = x.staff_id JOIN user_mean m ON m.user_id = w.user_id) GROUP BY 1, 2) s ON s.user_id = p.user_id AND s.item_id = p.item_id
    LEFT JOIN (SELECT user_id, v.item_id, sum(t.x * v.x) / nullif(sqrt(sum(t.x * t.x) * sum(v.x * v.x)), 0) AS cosine FROM taste t JOIN cells v USING (pos) GROUP BY 1, 2) c ON c.user_id = p.user_id AND c.item_id = p.item_id""",
    "user_mean", "rec_log", "item", "item_staff", "tag_vector", cells="SELECT item_id, CAST(unnest(vec) AS DOUBLE) AS x, generate_subscripts(vec, 1) AS pos FROM tag_vector WHERE item_id IN (SELECT item_id FROM rated UNION SELECT item_id FROM rec_log)",
    taste="SELECT w.user_id, v.pos, sum((w.score - m.mu) * w.w * v.x) AS x FROM weighted w JOIN user_mean m USING (user_id) JOIN cells v USING (item_id) WHERE w.user_id IN (SELECT user_id FROM rec_log) GROUP BY 1, 2"))
def user_rows(t: Tables) -> DataFrame:
    pairs = t.rec_log.select("user_id", "item_id").distinct()
    dev = session.staged(_dev(t).join(pairs.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", "d", "w"))
    cosine = text.vector_affinity(pairs, affinity.taste_vector(dev, t.tag_vector), t.tag_vector)
    rows = usermodel.user_rows(pairs, t.item.select("item_id", "title"), cosine, affinity.staff_affinity(pairs, dev, t.item_staff))
    return rows.select("user_id", "item_id", "title", *r6("staff_aff"), F.round("tag_cosine", 4).alias("tag_cosine"))


@query("usr19_extra_columns", oracle("SELECT item_id, 'x:drop_c' AS feature, round((log10(avg(CAST(status = 'dropped' AS INTEGER)) + 0.01) + 1.27) / 0.4, 6) AS value FROM list_entry GROUP BY 1 UNION ALL SELECT item_id, 'x:polar_c', round(coalesce((stddev_pop(score) FILTER (WHERE score > 0) - 1.78) / 0.3, 0), 6) FROM list_entry GROUP BY 1", "list_entry"))
def extra_columns(t: Tables) -> DataFrame:
    """The optional columns of titles with the audience's switched on."""
    items = t.list_entry.groupBy("item_id").agg(F.avg((F.col("status") == "dropped").cast("int")).alias("drop_rate"), F.stddev_pop(F.when(F.col("score") > 0, F.col("score"))).alias("score_sd"))
    return usermodel.audience_extras(items, Settings(content_audience=True)).select("item_id", "feature", *r6("value"))


_KEYED = """SELECT user_id, item_id, '{0}' AS surface, round(base + {1} * (1 - share) * CASE WHEN n > 1 THEN coalesce(stddev_pop(base) OVER p, 0) ELSE 0 END * CASE WHEN stddev_pop(known) OVER p > 1e-9 THEN (known - avg(known) OVER p) / stddev_pop(known) OVER p ELSE 0 END
    - {2} * 0.3 * CAST(num_episodes >= 50 AS INTEGER), 6) AS key FROM terms WINDOW p AS (PARTITION BY user_id)"""


@query("ltr7_tab_keys", oracle(_KEYED.format("safe_bets", 0.5, 0.5) + " UNION ALL " + _KEYED.format("discover", 0.0, 1.0) + " UNION ALL " + _KEYED.format("hidden_gems", 0.0, 1.0), "rated", "item", "item_stats",
    terms="SELECT user_id, item_id, num_episodes, 0.25 AS share, greatest(1, least(10, mean)) AS base, -log10(popularity) AS known, count(*) OVER (PARTITION BY user_id) AS n FROM rated JOIN item USING (item_id) JOIN item_stats USING (item_id)"))
def tab_keys(t: Tables) -> DataFrame:
    """The key of each list with a learned order, where safe bets take half of the risk: only they lean on what is well known."""
    s = Settings(**{**deployed().__dict__, "safe_bets_risk": 0.5})
    rows = t.rated.select("user_id", "item_id").join(t.item.select("item_id", "num_episodes", "status", "season_year"), "item_id").join(t.item_stats.select("item_id", "mean", "popularity"), "item_id")
    rows = rows.withColumns({"prediction": F.col("mean"), "personal": F.col("mean"), "stack": F.col("mean"), "share": F.lit(0.25), "z": F.lit(0.0), "unfamiliar": F.lit(False), "acclaim": F.lit(0.0), "evidence": F.lit(1.0)})
    out = None
    for surface in usermodel.enabled_surfaces(s):
        one = usermodel.order_key(rows, 2002, s, **usermodel.surface_key(surface, s)).select("user_id", "item_id", F.lit(surface).alias("surface"), *r6("key"))
        out = one if out is None else out.unionByName(one)
    return out
