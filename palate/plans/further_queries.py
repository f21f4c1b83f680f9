"""Driver queries over work selection, single writes, saved settings, features of a user's titles, choices of settings, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import affinity, candidates, evaluate, graph, logs, population, registry, rerank, taste, text, usermodel
from ..settings import Settings, deployed
from ..sources import merge, payloads, snapshots
from ..sources.projection import AS_OF, Tables
from ..sources.session import staged
from .more_queries import _TERMS, _TOP, _items, _terms, _toplist
from .oracle import oracle
from .queries import _EVAL, _FRANCHISE, _HASH, _MAIN, MIN_SCORERS, _dev, _franchise, _pairs, query, r6


# ---- work selection ----
def _stamped(t: Tables) -> DataFrame:
    """Titles with stamps: a third never fetched, a third a year ago, a third yesterday."""
    k = F.col("item_id") % 3
    day = F.lit(AS_OF) - F.make_dt_interval(F.when(k == 1, 365).otherwise(1))
    return _items(t).withColumns({"fetched_at": F.when(k > 0, day), "graph_fetched_at": F.when(F.col("item_id") % 4 > 0, F.lit(AS_OF)), "status_dist": F.when(F.col("item_id") % 5 > 0, F.lit("{}"))})


_STAMPED = "SELECT item.*, members, scorers, popularity, CASE item_id % 3 WHEN 1 THEN TIMESTAMP '2002-01-01' - INTERVAL 365 DAY WHEN 2 THEN TIMESTAMP '2002-01-01' - INTERVAL 1 DAY END AS fetched_at, item_id % 4 > 0 AS graphed, item_id % 5 > 0 AS counted FROM item LEFT JOIN item_stats USING (item_id)"


@query("sel3_second_source", oracle("SELECT item_id, item_id IN (SELECT item_id FROM list_entry) AS listed FROM stamped WHERE fetched_at IS NULL AND (coalesce(scorers, 0) >= 20 OR item_id IN (SELECT item_id FROM list_entry))", "item", "item_stats", stamped=_STAMPED))
def second_source(t: Tables) -> DataFrame:
    return merge.second_source_pending(_stamped(t), t.list_entry, 20)


@query("sel4_stale_recent", oracle("SELECT item_id FROM stamped WHERE (fetched_at IS NULL OR fetched_at < TIMESTAMP '2002-01-01' - INTERVAL 20 DAY) AND (status IN ('currently_airing', 'not_yet_aired') OR start_date >= DATE '2002-01-01' - 3650) AND (coalesce(members, 0) >= 30 OR item_id IN (SELECT item_id FROM list_entry))", "item", "item_stats", stamped=_STAMPED))
def stale_recent(t: Tables) -> DataFrame:
    return merge.stale(_stamped(t), t.list_entry, F.lit(AS_OF), 20, "recent", 3650, 30)


@query("sel5_upcoming", oracle("SELECT item_id FROM stamped WHERE status = 'not_yet_aired' AND NOT graphed AND coalesce(members, 0) >= 5", "item", "item_stats", stamped=_STAMPED))
def upcoming(t: Tables) -> DataFrame:
    return merge.upcoming_unlinked(_stamped(t), 5)


@query("sel6_details", oracle("SELECT item_id FROM stamped WHERE (NOT graphed OR NOT counted) AND coalesce(members, 0) >= 5", "item", "item_stats", stamped=_STAMPED))
def details(t: Tables) -> DataFrame:
    return merge.details_pending(_stamped(t), 5)


@query("sel7_list_needs", oracle("SELECT user_id, count(*) AS listed, count(*) FILTER (WHERE score > 0) AS rated, count(*) FILTER (WHERE item_id % 4 = 0) AS graph_missing, count(*) FILTER (WHERE score > 0 AND item_id % 3 = 0) AS tags_missing FROM list_entry GROUP BY 1", "list_entry"))
def list_needs(t: Tables) -> DataFrame:
    return merge.list_needs(t.list_entry, t.item.filter("item_id % 4 > 0"), t.item.filter("item_id % 3 > 0"))


# ---- single writes, logs, cursors ----
@query("snk10_stamped", oracle("SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM list_entry) THEN TIMESTAMP '2002-01-01' ELSE fetched_at END AS fetched_at FROM stamped", "item", "item_stats", stamped=_STAMPED))
def stamped(t: Tables) -> DataFrame:
    out = merge.stamped(_stamped(t).select("item_id", "fetched_at"), t.list_entry, "fetched_at", F.lit(AS_OF))
    return out.select("item_id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query("snk11_impressions", oracle(f"SELECT user_id, 'safe_bets' AS surface, item_id, position AS rank FROM ({_TOP}) WHERE position <= 7", "rated"))
def impressions(t: Tables) -> DataFrame:
    built = _toplist(t).withColumn("surface", F.lit("safe_bets")).withColumn("value", F.col("score").cast("double"))
    return merge.impressions(built, F.lit(AS_OF), 7).select("user_id", "surface", "item_id", "rank")


@query("snk12_resumed", oracle("SELECT item_id FROM item WHERE item_id > 100", "item"))
def resumed(t: Tables) -> DataFrame:
    cursor = t.item.filter("item_id <= 100").agg(F.max("item_id").alias("done")).withColumn("stage", F.lit("details"))
    return merge.resumed(cursor, t.item.select("item_id"), "details", "item_id")


@query("snk19_mirrored", oracle("""SELECT user_id, item_id, CASE WHEN item_id % 4 = 1 THEN 'completed' ELSE status END AS status, CASE WHEN item_id % 8 = 1 THEN 9 ELSE score END AS score, CASE WHEN item_id % 4 = 1 THEN greatest(item_id % 13, 5) ELSE item_id % 13 END AS episodes FROM list_entry WHERE item_id % 4 <> 2""", "list_entry"))
def mirrored(t: Tables) -> DataFrame:
    stored = t.list_entry.select("user_id", "item_id", "status", "score", (F.col("item_id") % 13).alias("episodes"), F.col("rated_at").cast("timestamp").alias("updated_at"))
    k = F.col("item_id") % 4
    writes = t.list_entry.filter(k.isin(1, 2)).select("user_id", "item_id", F.when(k == 1, "completed").alias("status"), F.when(F.col("item_id") % 8 == 1, 9).alias("score"), F.lit(5).cast("long").alias("episodes"))
    return merge.mirrored(stored, writes, F.lit(AS_OF)).select("user_id", "item_id", "status", "score", "episodes")


@query("snk23_undone", oracle("SELECT user_id, item_id, action, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, action ORDER BY created_at DESC) AS k FROM feedback) WHERE NOT (item_id % 3 = 0 AND k = 1)", "feedback"))
def undone(t: Tables) -> DataFrame:
    return merge.undone(t.feedback, t.feedback.filter("item_id % 3 = 0")).select("user_id", "item_id", "action", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("snk15_rotated", oracle("SELECT DISTINCT user_id FROM list_entry WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, max(rated_at) AS fetched FROM list_entry GROUP BY 1) WHERE fetched < TIMESTAMP '1998-01-01' ORDER BY fetched, sha256(CAST(user_id AS VARCHAR)) LIMIT 20)", "list_entry"))
def rotated(t: Tables) -> DataFrame:
    sample = t.list_entry.groupBy("user_id").agg(F.max("rated_at").cast("timestamp").alias("fetched_at")).withColumn("name_hash", F.sha2(F.col("user_id").cast("string"), 256))
    old = merge.rotated(sample, F.lit("1998-01-11").cast("timestamp"), 20, 10)
    return sample.join(old, "user_id", "left_anti").select("user_id")


@query("src7_snapshot", oracle("SELECT item_id, round(bias, 6) AS bias, n FROM bias", "rated", enough="SELECT item_id FROM rated GROUP BY 1 HAVING count(*) >= 15", kept="SELECT user_id, item_id, score - avg(score) OVER (PARTITION BY user_id) AS c FROM rated SEMI JOIN enough USING (item_id)", bias="SELECT item_id, sum(c) / (count(*) + 10.0) AS bias, count(*) AS n FROM kept GROUP BY 1"))
def snapshot(t: Tables) -> DataFrame:
    """A fitted model written as a snapshot and read back."""
    bias, _ = population.residuals(t.rated, 15)
    return snapshots.loaded(t.spark, snapshots.saved({"bias": bias}, snapshots.new_folder(t.spark)))["bias"].select("item_id", *r6("bias"), "n")


@query("src2_one_row", oracle("SELECT user_id, count(*) AS n FROM list_entry WHERE user_id = (SELECT min(user_id) FROM list_entry) GROUP BY 1", "list_entry"))
def one_row(t: Tables) -> DataFrame:
    first = snapshots.scalar(t.list_entry.agg(F.min("user_id")))
    return snapshots.required(t.list_entry.filter(F.col("user_id") == first).groupBy("user_id").agg(F.count("*").alias("n")))


# ---- predicates and labels ----
@query("prj6_saved_ranges", oracle("SELECT item_id, CASE WHEN num_episodes * 300 BETWEEN 0 AND 10000 THEN num_episodes * 300 END AS eps, CASE WHEN season_year - 70 BETWEEN 1900 AND 2100 THEN season_year - 70 END AS year FROM item", "item"))
def saved_ranges(t: Tables) -> DataFrame:
    return t.item.select("item_id", S.in_range(F.col("num_episodes") * 300, 0, 10_000).alias("eps"), S.in_range(F.col("season_year") - 70, 1900, 2100).alias("year"))


@query("prj10_themes", oracle("SELECT item_id, category FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'Theme-Action' WHEN 1 THEN 'Cast-Main' WHEN 2 THEN 'Setting' WHEN 3 THEN 'Demographic' END AS category FROM item) WHERE category LIKE 'Theme%' OR category LIKE 'Cast%' OR category LIKE 'Setting%'", "item"))
def themes(t: Tables) -> DataFrame:
    k = F.col("item_id") % 5
    rows = t.item.select("item_id", F.when(k == 0, "Theme-Action").when(k == 1, "Cast-Main").when(k == 2, "Setting").when(k == 3, "Demographic").alias("category"))
    return rows.filter(S.theme_category("category"))


@query("prj12_own_line", oracle("SELECT user_id, rho >= 0.3 AND slope >= 0.5 AS usable FROM (SELECT user_id, covar_pop(prediction, truth) / nullif(stddev_pop(prediction) * stddev_pop(truth), 0) AS rho, covar_pop(prediction, truth) / nullif(var_pop(prediction), 0) AS slope FROM pairs GROUP BY 1 HAVING count(*) >= 10)", "rated", "item_stats", pairs=_EVAL))
def own_line(t: Tables) -> DataFrame:
    lines = _pairs(t).groupBy("user_id").agg(F.count("*").alias("n"), S.correlation("prediction", "truth").alias("rho"), F.regr_slope("truth", "prediction").alias("slope")).filter("n >= 10")
    return lines.select("user_id", registry.own_line_usable("rho", "slope").alias("usable"))


@query("prj17_job_state", oracle("SELECT max(ts) FILTER (WHERE line LIKE '== start%') AS started_at, bool_or(regexp_matches(lower(line), 'error|failed|traceback')) FILTER (WHERE ts >= (SELECT max(ts) FROM lines WHERE line LIKE '== start%')) AS failed FROM lines", "ev", lines="SELECT ts, CASE event_type WHEN 'signup' THEN '== start' WHEN 'error' THEN 'Error: gone' ELSE 'ok' END AS line FROM ev"))
def job_state(t: Tables) -> DataFrame:
    lines = t.events.select(F.col("ts").alias("at"), F.when(F.col("event_type") == "signup", "== start").when(F.col("event_type") == "error", "Error: gone").otherwise("ok").alias("line"))
    return registry.job_state(lines, 24.0, F.lit(AS_OF).cast("timestamp")).select(F.col("started_at").cast("timestamp_ntz").alias("started_at"), "failed")


@query("sca15_labels", oracle("SELECT DISTINCT 'genre ' || g AS label FROM (SELECT unnest(genres) AS g FROM item) UNION SELECT DISTINCT 'studio ' || studio FROM item UNION SELECT DISTINCT 'format ' || media_type FROM item UNION SELECT DISTINCT 'years ' || CAST(season_year // 5 * 5 AS VARCHAR) FROM item UNION SELECT DISTINCT 'length ' || CASE WHEN num_episodes <= 13 THEN '1-13' WHEN num_episodes <= 26 THEN '14-26' WHEN num_episodes <= 60 THEN '27-60' ELSE '60+' END FROM item", "item"))
def labels(t: Tables) -> DataFrame:
    return usermodel.feature_values(t.item).select(S.feature_label("feature").alias("label")).distinct()


@query("sca17_size_lines", oracle("""SELECT user_id, round(CASE WHEN n <= 10 THEN 0.5 WHEN n >= 60 THEN 0.9 WHEN n < 25 THEN 0.5 + (0.7 - 0.5) * ln(n / 10.0) / ln(2.5) ELSE 0.7 + (0.9 - 0.7) * ln(n / 25.0) / ln(2.4) END, 6) AS slope FROM (SELECT user_id, count(*) AS n FROM rated GROUP BY 1)""", "rated"))
def size_line(t: Tables) -> DataFrame:
    lines = t.spark.createDataFrame([(10, 0.5, 3.0), (25, 0.7, 2.0), (60, 0.9, 1.0)], "n int, slope double, intercept double")
    return population.line_at(lines, t.rated.groupBy("user_id").agg(F.count("*").alias("n"))).select("user_id", *r6("slope"))


@query("sca19_error_kinds", "SELECT event_type, CASE event_type WHEN 'error' THEN 'source unavailable' WHEN 'click' THEN 'source busy' WHEN 'view' THEN 'list not readable' ELSE 'internal error' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def error_kinds(t: Tables) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "Read timed out").when(F.col("event_type") == "click", "HTTP 429").when(F.col("event_type") == "view", "the list is private").otherwise("oops")
    return t.events.groupBy("event_type", S.error_kind(said).alias("kind")).agg(F.count("*").alias("n"))


@query("usr17_serving_mode", oracle("SELECT user_id, CASE WHEN count(*) >= 30 THEN 'blend' ELSE 'sized' END AS mode FROM rated GROUP BY 1", "rated"))
def serving_mode(t: Tables) -> DataFrame:
    return t.rated.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", usermodel.serving_mode("n", 30).alias("mode"))


@query("usr13_ranking_share", oracle("SELECT user_id, round(1 / (1 + exp(-(count(*) - 80) / (80 / 3.0))), 6) AS share FROM rated GROUP BY 1", "rated"))
def ranking_share(t: Tables) -> DataFrame:
    return t.rated.groupBy("user_id").agg(F.round(S.size_share(F.count("*"), Settings().ranking_share_middle), 6).alias("share"))


@query("usr12_shown_value", oracle("SELECT user_id, item_id, round(greatest(1, least(10, coalesce(b, 1) * prediction + coalesce(a, 0))), 6) AS shown FROM pairs LEFT JOIN (SELECT user_id, regr_slope(truth, prediction) AS b, regr_intercept(truth, prediction) AS a FROM pairs GROUP BY 1 HAVING count(*) >= 10) USING (user_id)", "rated", "item_stats", pairs=_EVAL))
def shown_value(t: Tables) -> DataFrame:
    p = _pairs(t)
    lines = p.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("truth", "prediction").alias("slope"), F.regr_intercept("truth", "prediction").alias("intercept")).filter("n >= 10")
    return population.shown(p, lines).select("user_id", "item_id", *r6("shown"))


@query("usr16_versions", oracle("SELECT user_id, count(*) AS entries, max(rated_at) AS newest FROM list_entry GROUP BY 1", "list_entry"))
def versions(t: Tables) -> DataFrame:
    return registry.list_version(t.list_entry).select("user_id", "entries", "newest")


@query("prj13_outgrown", oracle("SELECT user_id, n >= greatest(m * 1.5, m + 10) AS outgrown FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE item_id % 3 > 0) AS m FROM list_entry GROUP BY 1)", "list_entry"))
def outgrown(t: Tables) -> DataFrame:
    n = t.list_entry.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("item_id") % 3 > 0).alias("m"))
    return n.select("user_id", registry.outgrown("n", "m").alias("outgrown"))


# ---- features and choices of a user ----
@query("usr1_user_features", oracle("""SELECT p.user_id, p.item_id, round(coalesce(aff, 0), 6) AS aff, round(coalesce(best, 0), 6) AS franchise_best, coalesce(known, false) AS franchise_known, round(coalesce(c.cosine, 0), 4) AS tag_cosine FROM (SELECT DISTINCT user_id, item_id FROM rec_log) p
    LEFT JOIN (SELECT w.user_id, e.src AS item_id, sum(e.weight * w.w * (w.score - m.mu)) / (sum(e.weight * w.w) + 1.5) AS aff FROM weighted w JOIN user_mean m USING (user_id) JOIN rec_edge e ON e.dst = w.item_id GROUP BY 1, 2) a ON a.user_id = p.user_id AND a.item_id = p.item_id
    LEFT JOIN (SELECT r.user_id, f.item_id, coalesce(max(d) FILTER (WHERE r.item_id <> f.item_id), 0) AS best, coalesce(bool_or(r.item_id <> f.item_id), false) AS known FROM franchise f JOIN rated_in r ON r.franchise_id = f.franchise_id GROUP BY 1, 2) b ON b.user_id = p.user_id AND b.item_id = p.item_id
    LEFT JOIN (SELECT user_id, v.item_id, sum(t.x * v.x) / nullif(sqrt(sum(t.x * t.x) * sum(v.x * v.x)), 0) AS cosine FROM taste t JOIN cells v USING (pos) GROUP BY 1, 2) c ON c.user_id = p.user_id AND c.item_id = p.item_id""",
    "user_mean", "rec_edge", "rec_log", "tag_vector", cells="SELECT item_id, CAST(unnest(vec) AS DOUBLE) AS x, generate_subscripts(vec, 1) AS pos FROM tag_vector WHERE item_id IN (SELECT item_id FROM rated UNION SELECT item_id FROM rec_log)",
    taste="SELECT w.user_id, v.pos, sum((w.score - m.mu) * w.w * v.x) AS x FROM weighted w JOIN user_mean m USING (user_id) JOIN cells v USING (item_id) WHERE w.user_id IN (SELECT user_id FROM rec_log) GROUP BY 1, 2", franchise=_FRANCHISE, rated_in="SELECT w.user_id, w.item_id, (w.score - m.mu) * w.w AS d, franchise_id FROM weighted w JOIN user_mean m USING (user_id) JOIN franchise USING (item_id)"))
def user_features(t: Tables) -> DataFrame:
    pairs, dev = t.rec_log.select("user_id", "item_id").distinct(), _dev(t)
    dev = staged(dev.join(pairs.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", "d", "w"))
    cosine = text.vector_affinity(pairs, affinity.taste_vector(dev, t.tag_vector), t.tag_vector)
    rows = usermodel.user_features(pairs, affinity.rec_affinity(dev, t.rec_edge, pairs=pairs), affinity.franchise_affinity(dev, _franchise(t), pairs), cosine)
    return rows.select("user_id", "item_id", *r6("aff", "franchise_best"), "franchise_known", F.round("tag_cosine", 4).alias("tag_cosine"))


@query("usr3_catalogue_features", oracle("SELECT item_id, feature, round(value, 6) AS value FROM (SELECT item_id, 'n:mean' AS feature, coalesce(mean, 7.5) - 7.5 AS value FROM item LEFT JOIN item_stats USING (item_id) UNION ALL SELECT item_id, 'n:audience', log10(coalesce(popularity, 5000)) - 3 FROM item LEFT JOIN item_stats USING (item_id) UNION ALL SELECT item_id, 'n:scorers', log10(CASE WHEN coalesce(scorers, 0) = 0 THEN 1000 ELSE scorers END) - 4 FROM item LEFT JOIN item_stats USING (item_id) UNION ALL SELECT item_id, 't:' || tag, max(rank) / 100 FROM tags GROUP BY 1, 2 UNION ALL SELECT DISTINCT item_id, f, 1.0 FROM (SELECT item_id, unnest(list_concat(list_transform(genres, lambda g: 'g:' || g), ['st:' || studio, 'mt:' || media_type, 'dec:' || CAST(season_year // 5 * 5 AS VARCHAR), 'len:' || CASE WHEN num_episodes <= 13 THEN '1-13' WHEN num_episodes <= 26 THEN '14-26' WHEN num_episodes <= 60 THEN '27-60' ELSE '60+' END])) AS f FROM item))", "item", "item_stats", "tag_vector", tags="SELECT item_id, unnest(genres) AS tag, num_episodes AS rank FROM item"))
def catalogue_features(t: Tables) -> DataFrame:
    tags = t.item.select("item_id", F.explode("genres").alias("tag"), F.col("num_episodes").alias("rank"))
    return usermodel.catalogue_features(_items(t), tags).select("item_id", "feature", *r6("value"))


@query("key6_acclaim", oracle("""SELECT user_id, item_id, round(x - usual, 6) AS acclaim FROM parts JOIN (SELECT user_id, avg(x) AS usual FROM parts GROUP BY 1) USING (user_id)""", "rated", "item_stats",
    parts="SELECT user_id, item_id, 0.5 * (coalesce(mean, 7.5) - 7.5) - 0.25 * (log10(popularity) - 3) AS x FROM rated JOIN item_stats USING (item_id)"))
def acclaim(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame([("n:mean", 0.5), ("n:audience", -0.25), ("g:red", 2.0)], "feature string, coef double")
    models = t.rated.select("user_id").distinct().crossJoin(F.broadcast(weights))  # three rows
    return usermodel.acclaim_lift(t.rated, models, usermodel.catalogue_features(_items(t)), t.rated).select("user_id", "item_id", *r6("acclaim"))


@query("key5_disagreement", oracle("""SELECT user_id, item_id, round(coalesce(((stack - ms) / ss - (personal - mp) / sp) * ss, 0), 6) AS gap FROM both_ LEFT JOIN (SELECT user_id, avg(stack) AS ms, stddev_pop(stack) AS ss, avg(personal) AS mp, stddev_pop(personal) AS sp FROM both_ GROUP BY 1 HAVING count(*) >= 20 AND stddev_pop(stack) > 1e-6 AND stddev_pop(personal) > 1e-6) USING (user_id)""", "rated", "item_stats",
    both_="SELECT user_id, item_id, mean AS stack, CAST(score AS DOUBLE) AS personal FROM rated JOIN item_stats USING (item_id)"))
def disagreement(t: Tables) -> DataFrame:
    rows = t.rated.select("user_id", "item_id", F.col("score").cast("double").alias("personal")).join(t.item_stats.select("item_id", F.col("mean").alias("stack")), "item_id")
    return usermodel.disagreement(rows, rows, "z").select("user_id", "item_id", *r6("gap"))


@query("usr7_blend_share", oracle("""SELECT user_id, share FROM (SELECT user_id, k / 10 AS share, row_number() OVER (PARTITION BY user_id ORDER BY round((k / 10) * (k / 10) * dd - 2 * (k / 10) * de, 9), k) AS r FROM (SELECT user_id, sum((score - mean) * (score - mean)) AS dd, sum((score - mean) * (7 - mean)) AS de FROM rated JOIN item_stats USING (item_id) GROUP BY 1 HAVING count(*) >= 20) CROSS JOIN range(11) x(k)) WHERE r = 1""", "rated", "item_stats"))
def blend_share(t: Tables) -> DataFrame:
    rows = t.rated.join(t.item_stats, "item_id").select("user_id", F.col("mean").alias("stack"), F.col("score").cast("double").alias("personal"), F.lit(7.0).alias("truth"))
    return usermodel.blend_search(rows)


@query("usr8_half_life", oracle("SELECT user_id, CASE WHEN max(n) >= 20 AND coalesce(max(rho) > coalesce(max(rho) FILTER (WHERE value = 0.5), -1) + 0.002, false) THEN arg_min(value, struct_pack(a := -rho, b := value)) FILTER (WHERE rho IS NOT NULL) ELSE CAST(0.5 AS DOUBLE) END AS value FROM scores GROUP BY 1", "rated",
    scores="SELECT user_id, CAST(0.5 AS DOUBLE) AS value, round(avg(score) / 10, 6) AS rho, count(*) AS n FROM rated GROUP BY 1 UNION ALL SELECT user_id, 0.35, round(avg(score) FILTER (WHERE item_id % 2 = 0) / 10, 6), count(*) FROM rated GROUP BY 1"))
def half_life(t: Tables) -> DataFrame:
    mean = lambda c, v: t.rated.groupBy("user_id").agg(F.lit(v).alias("value"), F.round(F.avg(c) / 10, 6).alias("rho"), F.count("*").alias("n"))
    scores = mean(F.col("score"), 0.5).unionByName(mean(F.when(F.col("item_id") % 2 == 0, F.col("score")), 0.35))
    return usermodel.choose_setting(scores, 0.5, least=20)


@query("usr10_level_trend", oracle("SELECT user_id, item_id, round(least((epoch_us(max(rated_at) OVER (PARTITION BY user_id)) - epoch_us(rated_at)) / 1e6 / 31557600, 3), 6) AS age_y FROM rated", "rated"))
def level_trend(t: Tables) -> DataFrame:
    return usermodel.level_trend(t.rated).select("user_id", "item_id", *r6("age_y"))


@query("usr15_taught_examples", oracle("""SELECT user_id, item_id, round(score, 6) AS score, round(w, 6) AS w FROM (SELECT user_id, item_id, CAST(score AS DOUBLE) AS score, w FROM weighted UNION ALL
    SELECT user_id, item_id, greatest(1, least(10, mean + CASE status WHEN 'dropped' THEN -1.5 WHEN 'on_hold' THEN -0.5 ELSE 0 END)), 0.8 * (0.05 + 0.95 * pow(0.5, greatest((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(rated_at)) / 1e6 / 31557600, 0) / 0.5)) FROM (SELECT *, avg(score) FILTER (WHERE score > 0) OVER (PARTITION BY user_id) AS mean FROM list_entry) WHERE score = 0 AND mean IS NOT NULL AND status IN ('dropped', 'on_hold', 'completed')
    UNION ALL SELECT b.user_id, b.item_id, greatest(any_value(m.mean) - 1.0, 1.0), 0.4 * (0.05 + 0.95 * pow(0.5, greatest((epoch_us(TIMESTAMP '2002-01-01') - max(epoch_us(b.created_at))) / 1e6 / 31557600, 0) / 0.5)) FROM feedback b JOIN (SELECT user_id, avg(score) AS mean FROM rated GROUP BY 1) m USING (user_id)
    WHERE b.action = 'not_interested' AND NOT EXISTS (SELECT 1 FROM list_entry e WHERE e.user_id = b.user_id AND e.item_id = b.item_id) GROUP BY 1, 2)""", "weighted", "feedback"))
def taught_examples(t: Tables) -> DataFrame:
    from .build import Inputs, taught_examples

    return taught_examples(Inputs(t.list_entry, t.item, t.relation, t.feedback, _franchise(t), AS_OF), Settings()).select("user_id", "item_id", *r6("score", "w"))


@query("usr18_error_ranges", oracle("SELECT user_id, CASE WHEN count(*) >= 20 THEN 'own' ELSE 'size' END AS source, 21 AS quantiles FROM pairs GROUP BY 1", "rated", "item_stats", pairs=_EVAL))
def error_ranges(t: Tables) -> DataFrame:
    p = _pairs(t)
    sizes = p.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = evaluate.user_quantiles(sizes, evaluate.residual_quantiles(p, "user_id"), evaluate.residual_quantiles(p), 20)
    return rows.select("user_id", "source", F.size("q").alias("quantiles"))


@query("exp1_contributions", oracle("""SELECT user_id, item_id, feature, round(x - total / n, 6) AS part FROM (SELECT user_id, item_id, 'g:' || g AS feature, 1.0 * length(g) AS x, sum(1.0 * length(g)) OVER (PARTITION BY user_id, g) AS total FROM (SELECT DISTINCT user_id, item_id, g FROM rated JOIN (SELECT item_id, unnest(genres) AS g FROM item) USING (item_id))) JOIN (SELECT user_id, count(*) AS n FROM rated GROUP BY 1) USING (user_id)""", "rated", "item"))
def contributions(t: Tables) -> DataFrame:
    features = usermodel.feature_values(t.item).filter("feature like 'g:%'")
    models = t.rated.select("user_id").distinct().crossJoin(F.broadcast(features.select("feature").distinct())).withColumn("coef", (F.length("feature") - 2).cast("double"))  # the genres
    return usermodel.contributions(t.rated, models, features, 1000).select("user_id", "item_id", "feature", *r6("part"))


#: Every term of the order key of ``_TERMS``, and what a ranker sees of a row.
_PARTS = """SELECT *, 0.5 * (1 - share) * coalesce(stddev_pop(shown + relevance) OVER p, 0) * CASE WHEN stddev_pop(known) OVER p > 1e-9 THEN (known - avg(known) OVER p) / stddev_pop(known) OVER p ELSE 0 END AS prior FROM (
    SELECT *, greatest(1, least(10, prediction)) AS shown, 0.5 * (1 - share) * z + 0.5 * share * greatest(-2, least(2, z)) AS relevance, -log10(popularity) AS known, CAST(0.3 AS DOUBLE) * CAST(num_episodes >= 50 AS INTEGER) AS risk_long, share / 0.5 * 0.5 * greatest(stack - personal, 0) AS risk_disagree,
    share / 0.5 * 0.3 * CAST(unfamiliar AS INTEGER) AS risk_unfamiliar, share / 0.5 * 0.6 * greatest(acclaim, 0) * 0.1 / (0.1 + evidence) AS risk_acclaim FROM terms) WINDOW p AS (PARTITION BY user_id)"""


@query("exp3_explained", oracle("""SELECT user_id, term, round(sum(points), 6) + 0.0 AS points FROM (SELECT user_id, unnest(['shown', 'relevance', 'prior', 'long', 'disagree', 'unfamiliar', 'acclaim']) AS term, unnest([shown, relevance, prior, -risk_long, -risk_disagree, -risk_unfamiliar, -risk_acclaim]) AS points FROM parts) GROUP BY 1, 2""", "rated", "item", "item_stats", terms=_TERMS, parts=_PARTS))
def explained(t: Tables) -> DataFrame:
    rows = usermodel.explain_terms(usermodel.order_key(_terms(t), 2002, deployed(), 0.5))
    return rows.groupBy("user_id", "term").agg((F.round(F.sum("points"), 6) + 0.0).alias("points"))


@query("ltr1_ranking_inputs", oracle(f"""SELECT p.user_id, p.item_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("shown", "z", "prior", "risk_long", "risk_disagree", "risk_unfamiliar", "risk_acclaim", "share"))}, round(stack, 6) AS pred_pop, round(personal, 6) AS pred_personal, round(personal - stack, 6) AS pred_gap, round(ln(1 + n), 6) AS log_n, round(mean, 6) AS mean,
    round(ln(1 + scorers), 6) AS log_scorers, round(log10(s.popularity), 6) AS log_rank, CAST(2002 - season_year AS DOUBLE) AS age, CAST(i.num_episodes AS DOUBLE) AS episodes, round(least(1.0, log10(greatest(s.popularity, 1)) / 3.7), 6) AS novelty, round(coalesce(fit, 0), 6) AS genre_fit, round(coalesce(long_share, 0), 6) AS long_share, round(coalesce(long_lift, 0), 6) AS long_lift, round(coalesce(long_drop, 0), 6) AS long_drop
    FROM parts p JOIN item i USING (item_id) JOIN item_stats s USING (item_id) LEFT JOIN fits f ON f.user_id = p.user_id AND f.item_id = p.item_id LEFT JOIN longs l ON l.user_id = p.user_id""", "weighted", "item", "item_stats", terms=_TERMS, parts=_PARTS,
    profile="SELECT user_id, genre, x / sum(x) OVER (PARTITION BY user_id) AS part FROM (SELECT user_id, genre, sum(w / n) AS x FROM weighted JOIN (SELECT item_id, unnest(genres) AS genre, len(genres) AS n FROM item) USING (item_id) GROUP BY 1, 2)",
    fits="SELECT r.user_id, r.item_id, sum(part) / any_value(n) AS fit FROM rated r JOIN (SELECT item_id, unnest(genres) AS genre, greatest(len(genres), 1) AS n FROM item) g USING (item_id) JOIN profile q ON q.user_id = r.user_id AND q.genre = g.genre GROUP BY 1, 2",
    longs="SELECT user_id, avg(CAST(num_episodes >= 50 AS INTEGER)) AS long_share, coalesce(avg(score) FILTER (WHERE num_episodes >= 50 AND score > 0) - avg(score) FILTER (WHERE score > 0), 0) AS long_lift, coalesce(avg(CAST(list_entry.status = 'dropped' AS INTEGER)) FILTER (WHERE num_episodes >= 50) - avg(CAST(list_entry.status = 'dropped' AS INTEGER)) FILTER (WHERE num_episodes < 50), 0) AS long_drop FROM list_entry JOIN item USING (item_id) GROUP BY 1"))
def ranking_inputs(t: Tables) -> DataFrame:
    whole = ("age", "episodes")
    return _ranking_rows(t).select("user_id", "item_id", *r6(*(c for c in usermodel.RANKING_INPUTS if c not in whole)), *whole)


def _ranking_rows(t: Tables) -> DataFrame:
    taste_ = affinity.long_series_taste(t.list_entry, t.item).select("user_id", F.col("share").alias("long_share"), F.col("lift").alias("long_lift"), F.col("drop").alias("long_drop"))
    profile = affinity.genre_profile(affinity.scored_entries(t.rated, AS_OF), t.item)
    terms = staged(usermodel.order_key(_terms(t), 2002, deployed(), 0.5))
    return usermodel.ranking_rows(terms, _items(t), taste_, profile, 2002)


@query("ltr3_boosted_order")
def boosted_order(t: Tables) -> DataFrame:
    mu = t.rated.groupBy("user_id").agg(F.avg("score").alias("mu"))
    gains = usermodel.rank_labels(t.rated.join(mu, "user_id").join(evaluate.propensity(t.list_entry), "item_id").withColumn("listed", F.lit(True))).select("user_id", "item_id", "gain")
    rows = staged(_ranking_rows(t).join(gains, ["user_id", "item_id"]))
    return usermodel.fit_boosted(rows).transform(rows).select("user_id", "item_id", "learned")


# ---- pages ----
@query("grf10_derived", oracle("SELECT DISTINCT src AS item_id FROM relation WHERE relation_type IN ('parent_story', 'full_story')", "relation"))
def derived(t: Tables) -> DataFrame:
    return candidates.derived_titles(t.relation)


@query("cnd17_pool", oracle(f"SELECT item_id FROM item JOIN item_stats USING (item_id) WHERE {_MAIN} AND scorers >= {MIN_SCORERS} AND (status <> 'not_yet_aired' OR start_date <= DATE '2002-01-01') AND nsfw = 'white' AND item_id NOT IN (SELECT src FROM relation WHERE relation_type IN ('parent_story', 'full_story'))", "item", "item_stats", "relation"))
def pool(t: Tables) -> DataFrame:
    offered = candidates.offered_items(_items(t), AS_OF, MIN_SCORERS)
    return candidates.surface_pool(offered, candidates.derived_titles(t.relation)).select("item_id")


@query("cnd18_item_detail", oracle("SELECT item_id, title, franchise_id, array_to_string(list_transform(list_sort(list_transform(genres, lambda g: struct_pack(a := -length(g), b := g))), lambda x: x.b), ',') AS tags FROM item JOIN franchise USING (item_id)", "item", franchise=_FRANCHISE))
def item_detail(t: Tables) -> DataFrame:
    tags = t.item.select("item_id", F.explode("genres").alias("tag")).withColumn("rank", F.length("tag") + 50)
    return candidates.item_detail(t.item, _franchise(t), tags).select("item_id", "title", "franchise_id", F.array_join("tags", ",").alias("tags"))


@query("cnd12_filtered_read", oracle(f"""SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, item_id) AS INTEGER) AS position FROM (SELECT s.user_id, s.item_id, s.score AS value FROM ({_TOP.replace("AS position", "AS position, score")}) s JOIN item USING (item_id) WHERE position <= 40 AND item_id % 7 > 0 AND season_year >= 1980 QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY item_id) = 1)
    QUALIFY position <= 5""", "rated", "item"))
def filtered_read(t: Tables) -> DataFrame:
    """A stored shortlist read with a filter by year, after some titles were listed; no genres are shared, no novelty counts."""
    plain = t.item.select("item_id", "season_year", F.lit(1).alias("popularity"), F.array().cast("array<string>").alias("genres"), F.col("item_id").alias("franchise_id"))
    shortlist = _toplist(t).filter("position <= 40").withColumn("key", F.col("score").cast("double")).withColumn("novelty_scale", F.lit(0.0)).join(plain, "item_id")
    since = t.rated.filter("item_id % 7 = 0")
    return rerank.read_list(shortlist, since, candidates.keep_filter(years=(1980, None)), Settings(), 5).select("user_id", "item_id", F.col("position").cast("int").alias("position"))


@query("cnd22_partners", "SELECT o_custkey AS user_id, o_orderkey AS other_id, CASE WHEN o_orderkey % 3 = 0 THEN 'partner' ELSE 'outgoing' END AS state FROM orders UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'partner' ELSE 'incoming' END FROM orders")
def partners(t: Tables) -> DataFrame:
    pairs = t.read("orders").select(F.col("o_custkey").alias("inviter"), F.col("o_orderkey").alias("invitee"), F.when(F.col("o_orderkey") % 3 == 0, "accepted").otherwise("pending").alias("status"))
    return registry.partners(pairs)


@query("agg19_scale", oracle("SELECT user_id, count(*) AS rated, round(avg(score - mean), 6) AS diff, round(avg(CAST(score - mean >= 0.5 AS INTEGER)), 6) AS above, round(avg(CAST(score - mean <= -0.5 AS INTEGER)), 6) AS below, array_to_string(list_transform(range(1, 11), lambda s: len(list_filter(list(score), lambda x: x = s))), ',') AS hist FROM rated JOIN item_stats USING (item_id) GROUP BY 1", "rated", "item_stats"))
def scale(t: Tables) -> DataFrame:
    return taste.scale(t.rated, t.item_stats).select("user_id", "rated", *r6("diff", "above", "below"), F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist"))


@query("agg19_disagreements", oracle("SELECT user_id, side, item_id, rank, round(diff, 6) AS diff FROM (SELECT user_id, item_id, score - mean AS diff, CASE WHEN score > mean THEN 'above' ELSE 'below' END AS side, row_number() OVER (PARTITION BY user_id, score > mean ORDER BY round(abs(score - mean), 9) DESC, item_id) AS rank FROM rated JOIN item_stats USING (item_id) WHERE scorers >= 20 AND abs(score - mean) >= 2) WHERE rank <= 3", "rated", "item_stats"))
def disagreements(t: Tables) -> DataFrame:
    return taste.disagreements(t.rated, t.item_stats, 20, 2.0, 3).select("user_id", "side", "item_id", "rank", *r6("diff"))


@query("agg31_taste_page", oracle("SELECT user_id, count(*) AS entries, count(DISTINCT franchise_id) AS series, count(*) FILTER (WHERE score > 0) AS rated, round(avg(score) FILTER (WHERE score > 0), 6) AS mean, count(*) FILTER (WHERE status = 'completed') AS completed, round(sum(num_episodes * CAST(0.4 AS DOUBLE)) FILTER (WHERE status <> 'plan_to_watch'), 6) AS hours FROM list_entry JOIN (SELECT item_id, num_episodes FROM item) USING (item_id) JOIN franchise USING (item_id) GROUP BY 1", "list_entry", "item", franchise=_FRANCHISE))
def taste_page(t: Tables) -> DataFrame:
    rows = taste.list_facts(t.list_entry, t.item, _franchise(t).withColumnRenamed("franchise_id", "series_id"), 1440)
    return rows.select("user_id", "entries", "series", "rated", *r6("mean"), "completed", *r6("hours"))


@query("agg32_model_info", oracle("SELECT user_id, feature, rank FROM (SELECT user_id, feature, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, feature) AS rank FROM (SELECT user_id, 'g:' || g AS feature, count(*) AS n FROM rated JOIN (SELECT DISTINCT item_id, unnest(genres) AS g FROM item) USING (item_id) GROUP BY 1, 2)) WHERE rank <= 3", "rated", "item"))
def model_info(t: Tables) -> DataFrame:
    models = t.rated.join(usermodel.feature_values(t.item).filter("feature like 'g:%'"), "item_id").groupBy("user_id", "feature").agg(F.count("*").cast("double").alias("coef"))
    return usermodel.feature_importance(models, 3).select("user_id", "feature", "rank")


@query("evl15_report", oracle("""SELECT user_id, name, round(CASE WHEN count(*) < 3 OR stddev_pop(ra) = 0 OR stddev_pop(rb) = 0 THEN 0 ELSE corr(ra, rb) END, 6) AS rho FROM (SELECT user_id, name, rank() OVER (PARTITION BY user_id, name ORDER BY value) + (count(*) OVER (PARTITION BY user_id, name, value) - 1) / 2 AS ra, rank() OVER (PARTITION BY user_id, name ORDER BY truth) + (count(*) OVER (PARTITION BY user_id, name, truth) - 1) / 2 AS rb
    FROM (SELECT user_id, 'community' AS name, mean AS value, score AS truth FROM rated JOIN item_stats USING (item_id) UNION ALL SELECT user_id, 'model', CAST(item_id % 17 AS DOUBLE), score FROM rated JOIN item_stats USING (item_id))) GROUP BY 1, 2""", "rated", "item_stats"))
def report(t: Tables) -> DataFrame:
    rows = t.rated.join(t.item_stats, "item_id").select("user_id", F.col("score").alias("truth"), F.col("mean").alias("community"), (F.col("item_id") % 17).cast("double").alias("model"))
    return evaluate.compared_orders(rows, ("model", "community")).select("user_id", "name", *r6("rho"))


@query("evl10_age_shares", oracle("SELECT user_id, round(avg(CAST(2002 - season_year < 2 AS INTEGER)), 6) AS fresh, round(avg(CAST(2002 - season_year >= 10 AS INTEGER)), 6) AS old, count(*) - count(DISTINCT franchise_id) AS repeats FROM (SELECT * FROM ({0}) WHERE position <= 20) JOIN item USING (item_id) JOIN franchise USING (item_id) GROUP BY 1".format(_TOP), "rated", "item", franchise=_FRANCHISE))
def age_shares(t: Tables) -> DataFrame:
    return evaluate.age_shares(_toplist(t).filter("position <= 20"), t.item, _franchise(t), 2002).select("user_id", *r6("fresh", "old"), "repeats")


@query("evl6_grid", oracle("SELECT half_life, round(sqrt(avg((p - truth) * (p - truth))), 6) AS rmse FROM (SELECT h.half_life, t.score AS truth, (SELECT sum(r.score * (0.05 + 0.95 * pow(0.5, greatest((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(r.rated_at)) / 1e6 / 31557600, 0) / h.half_life))) / sum(0.05 + 0.95 * pow(0.5, greatest((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(r.rated_at)) / 1e6 / 31557600, 0) / h.half_life)) FROM split r WHERE r.user_id = t.user_id AND NOT r.held) AS p FROM split t CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (4.0)) h(half_life) WHERE t.held) WHERE p IS NOT NULL GROUP BY 1", "rated",
    split="SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rated_at DESC, item_id DESC) <= 5 AS held FROM rated"))
def grid(t: Tables) -> DataFrame:
    """The error of a user's weighted mean on the newest ratings, for half-lives on a grid."""
    split = evaluate.newest_holdout(t.rated)

    def tried(half_life: float) -> DataFrame:
        mean = affinity.user_mean(affinity.scored_entries(split.filter("not held"), AS_OF, half_life)).select("user_id", F.col("mu").alias("prediction"))
        return split.filter("held").join(mean, "user_id").select(F.lit("all").alias("user_id"), "prediction", F.col("score").alias("truth"))

    return evaluate.grid_errors({h: tried(h) for h in (0.5, 1.0, 4.0)}).select(F.col("setting").alias("half_life"), *r6("rmse"))


@query("evl17_last_half_life", oracle("SELECT user_id, item_id % 2 AS half_life FROM list_entry QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rated_at DESC, item_id DESC) = 1", "list_entry"))
def last_half_life(t: Tables) -> DataFrame:
    runs = t.list_entry.select("user_id", F.col("item_id").alias("id"), F.col("rated_at").alias("made_at"), (F.col("item_id") % 2).alias("half_life"))
    return registry.newest_run(runs).select("user_id", "half_life")


@query("cnd16_smart_cards", oracle("""SELECT user_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(listed * exp(z) * spread, 6) DESC, item_id) AS rank FROM (SELECT u.user_id, o.item_id, listed, spread, CASE WHEN stddev_pop(o.item_id % 10) OVER p > 1e-9 THEN (o.item_id % 10 - avg(o.item_id % 10) OVER p) / stddev_pop(o.item_id % 10) OVER p ELSE 0 END AS z
    FROM (SELECT DISTINCT user_id FROM list_entry) u CROSS JOIN cards o WHERE NOT EXISTS (SELECT 1 FROM list_entry e WHERE e.user_id = u.user_id AND e.item_id = o.item_id) AND NOT EXISTS (SELECT 1 FROM feedback b WHERE b.user_id = u.user_id AND b.item_id = o.item_id) WINDOW p AS (PARTITION BY u.user_id))) WHERE rank <= 15""", "list_entry", "feedback",
    cards="SELECT item_id, count(*) AS listed, stddev_pop(x) AS spread FROM (SELECT item_id, CASE WHEN score > 0 THEN score - avg(score) FILTER (WHERE score > 0) OVER (PARTITION BY user_id) END AS x FROM list_entry) GROUP BY 1 HAVING count(x) >= 15 ORDER BY 2 DESC, 1 LIMIT 100"))
def smart_cards(t: Tables) -> DataFrame:
    opinions = affinity.item_opinions(t.list_entry, 15, 100)
    relevance = t.list_entry.select("user_id").distinct().crossJoin(F.broadcast(opinions.select("item_id", (F.col("item_id") % 10).cast("double").alias("rel"))))  # a hundred cards
    return candidates.quiz_cards(t.list_entry, t.feedback, opinions, t.list_entry, 15, relevance)


@query("joi12_parallel_arrays", oracle("SELECT item_id, unnest(genres) AS tag, unnest(list_transform(genres, lambda g: length(g))) AS rank FROM item", "item"))
def parallel_arrays(t: Tables) -> DataFrame:
    return payloads.unzipped(t.item.select("item_id", F.col("genres").alias("tag"), F.transform("genres", F.length).alias("rank")), "item_id", ("tag", "rank"))
