"""Logs: impressions and their outcomes, usage counters, feedback summaries, fingerprints."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_shown(log: DataFrame, *keys: Column | str, surface: str | None = None, top: int | None = None) -> DataFrame:
    """The earliest impression of each (user_id, item_id, keys): a partial minimum, no sort of groups."""
    rows = log if surface is None else log.filter(F.col("surface") == surface)
    rows = rows if top is None else rows.filter(F.col("rank") <= top)
    rest = [c for c in log.columns if c not in ("user_id", "item_id", "shown_at")]
    named = [k if isinstance(k, str) else k for k in keys]
    best = rows.groupBy("user_id", "item_id", *named).agg(F.min(F.struct("shown_at", *rest)).alias("e"))
    skip = {k for k in keys if isinstance(k, str)}
    extra = [c for c in best.columns if c not in ("e",)]
    return best.select(*extra, "e.shown_at", *(F.col(f"e.{c}") for c in rest if c not in skip))


def _positive(status: str, score: str, mu: str) -> Column:
    return F.coalesce(F.col(status).isin("plan_to_watch", "watching") | ((F.col(status) == "completed") & (F.col(score) == 0)) | ((F.col(score) > 0) & (F.col(score) >= F.col(mu))), F.lit(False))


def _negative(status: str, score: str, mu: str) -> Column:
    return F.coalesce((F.col(status) == "dropped") | ((F.col(score) > 0) & (F.col(score) < F.col(mu) - 1)), F.lit(False))


def user_means(entries: DataFrame) -> DataFrame:
    return entries.filter("score > 0").groupBy("user_id").agg(F.avg("score").alias("mu"))


def _reactions(shown: DataFrame, feedback: DataFrame, until: bool) -> DataFrame:
    """(user_id, item_id, shown_at, queued, refused): whether feedback of either kind followed an impression (within its window)."""
    fb = feedback.filter(F.col("action").isin("queued", "not_interested"))
    at = shown.select("user_id", "item_id", "shown_at", *(["until"] if until else [])).join(fb, ["user_id", "item_id"]).filter(F.col("created_at") >= F.col("shown_at"))
    at = at.filter(F.col("created_at") < F.col("until")) if until else at
    return at.groupBy("user_id", "item_id", "shown_at").agg(F.bool_or(F.col("action") == "queued").alias("queued"), F.bool_or(F.col("action") == "not_interested").alias("refused"))


def outcomes(log: DataFrame, entries: DataFrame, feedback: DataFrame, surfaces: tuple[str, ...]) -> DataFrame:
    """First impressions with positive and negative: what feedback and the list said afterwards, at any time."""
    shown = first_shown(log.filter(F.col("surface").isin(*surfaces)))
    later = entries.select("user_id", "item_id", "status", "score", "rated_at")
    at = shown.join(later, ["user_id", "item_id"], "left").withColumns({c: F.when(F.col("rated_at") >= F.col("shown_at"), F.col(c)) for c in ("status", "score")})
    at = at.join(user_means(entries), "user_id", "left").join(_reactions(shown, feedback, False), ["user_id", "item_id", "shown_at"], "left").fillna({"queued": False, "refused": False})
    return at.select("user_id", "item_id", "surface", "rank", "predicted", "shown_at", (F.col("queued") | _positive("status", "score", "mu")).alias("positive"), (F.col("refused") | _negative("status", "score", "mu")).alias("negative"))


def period_outcomes(log: DataFrame, entries: DataFrame, feedback: DataFrame, list_events: DataFrame, cut: datetime, as_of: datetime, surface: str, top: int = 20, days: int = 28) -> DataFrame:
    """(user_id, item_id, after, complete, tracked, positive, negative) of first impressions before and after a cut.

    Windows are [shown_at, shown_at + days). Where the change log reaches back to the impression it decides; else the list does.
    """
    shown = first_shown(log.withColumn("after", F.col("shown_at") >= F.lit(cut)), "after", surface=surface, top=top)
    since = list_events.agg(F.min("at").alias("since"))
    shown = shown.crossJoin(F.broadcast(since)).withColumns({"until": F.col("shown_at") + F.make_dt_interval(F.lit(days)), "tracked": F.coalesce(F.col("shown_at") >= F.col("since"), F.lit(False))}).select("user_id", "item_id", "after", "shown_at", "until", "tracked")  # one row
    shown = shown.join(user_means(entries), "user_id", "left")
    keys = ["user_id", "item_id", "shown_at"]
    ev = shown.join(list_events.select("user_id", "item_id", F.col("status").alias("es"), F.col("score").alias("ec"), "at"), ["user_id", "item_id"]).filter((F.col("at") >= F.col("shown_at")) & (F.col("at") < F.col("until")))
    ev = ev.groupBy(*keys).agg(F.bool_or(_positive("es", "ec", "mu")).alias("ep"), F.bool_or(_negative("es", "ec", "mu")).alias("en"))
    li = shown.select(*keys, "until", "mu").join(entries, ["user_id", "item_id"]).filter((F.col("rated_at") >= F.col("shown_at")) & (F.col("rated_at") < F.col("until"))).groupBy(*keys).agg(F.bool_or(_positive("status", "score", "mu")).alias("lp"), F.bool_or(_negative("status", "score", "mu")).alias("ln"))
    at = shown.join(_reactions(shown, feedback, True), keys, "left").join(ev, keys, "left").join(li, keys, "left").fillna({c: False for c in ("queued", "refused", "ep", "en", "lp", "ln")})
    pick = lambda fb, e, l: F.col(fb) | F.when(F.col("tracked"), F.col(e)).otherwise(F.col(l))
    return at.select("user_id", "item_id", "after", (F.col("until") <= F.lit(as_of)).alias("complete"), "tracked", pick("queued", "ep", "lp").alias("positive"), pick("refused", "en", "ln").alias("negative"))


def outcome_rates(rows: DataFrame) -> DataFrame:
    """(after, positive, negative, users): means over users of their own means, complete windows only."""
    each = rows.filter("complete").groupBy("after", "user_id").agg(F.avg(F.col("positive").cast("double")).alias("p"), F.avg(F.col("negative").cast("double")).alias("n"))
    return each.groupBy("after").agg(F.avg("p").alias("positive"), F.avg("n").alias("negative"), F.count("*").alias("users"))


def prospective_pairs(log: DataFrame, entries: DataFrame) -> DataFrame:
    """(user_id, item_id, prediction, truth): the first shown prediction against the rating given later."""
    shown = first_shown(log).select("user_id", "item_id", "shown_at", F.col("predicted").alias("prediction"))
    return shown.join(entries.filter("score > 0"), ["user_id", "item_id"]).filter(F.col("rated_at") > F.col("shown_at")).select("user_id", "item_id", "prediction", F.col("score").alias("truth"))


def daily_usage(events: DataFrame) -> DataFrame:
    """(user_id, kind, item_id, day, n, first_at, last_at, value): counters a day; the value of the newest event stays."""
    return events.groupBy("user_id", F.col("event_type").alias("kind"), "item_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


FUNNEL = ("signup", "view", "click", "purchase")


def funnel(events: DataFrame, steps: tuple[str, ...] = FUNNEL) -> DataFrame:
    """(step, users): users that took a step and all before it; never grows along the steps."""
    each = events.filter(F.col("event_type").isin(*steps)).groupBy("user_id").agg(F.collect_set("event_type").alias("did"))  # a set of the steps at most
    reach, upto = [], F.lit(True)
    for k, s in enumerate(steps):
        upto = upto & F.array_contains("did", s)
        reach.append(F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("name"), F.count_if(upto).alias("users")))
    return each.agg(F.array(*reach).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def user_activity(events: DataFrame) -> DataFrame:
    """(user_id, days, items, events): distinct days and items of each user."""
    return events.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("item_id").alias("items"), F.count("*").alias("events"))


def latest_action(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("user_id").agg(F.max(F.struct("created_at", "item_id", "action")).alias("e")).select("user_id", "e.*")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("user_id", "action").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def weekly_digest(lists: DataFrame, items: DataFrame, show: int = 3) -> DataFrame:
    """(user_id, n, titles): how many titles a list has and the names of the first ``show``."""
    named = lists.join(items.select("item_id", "title"), "item_id")
    return named.groupBy("user_id").agg(F.count("*").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("position", "title"))), 1, show), lambda x: x["title"]).alias("titles"))  # a list's length


def list_fingerprint(entries: DataFrame) -> DataFrame:
    """(user_id, fingerprint): md5 over a list in item order."""
    line = F.concat_ws(":", F.col("item_id").cast("string"), "status", F.col("score").cast("string"))
    return entries.groupBy("user_id").agg(F.md5(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", line.alias("line")))), lambda x: x["line"]), ","), "UTF-8")).alias("fingerprint"))  # one user's list


def stale_users(now: DataFrame, built: DataFrame) -> DataFrame:
    """Users whose list changed since it was built, or was never built."""
    return now.join(built.select("user_id", F.col("fingerprint").alias("old")), "user_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("old"))).select("user_id")


def profile_counts(entries: DataFrame) -> DataFrame:
    """(user_id, total, rated, completed, dropped, planned, mean): one pass of conditional counts; the mean as a decimal of two places."""
    has = lambda s: F.count_if(F.col("status") == s)
    mean = F.avg(F.when(F.col("score") > 0, F.col("score")))
    return entries.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("score") > 0).alias("rated"), has("completed").alias("completed"), has("dropped").alias("dropped"), has("plan_to_watch").alias("planned"), F.round(mean.cast("decimal(20,10)"), 2).cast("double").alias("mean"))


def kept_newest(rows: DataFrame, n: int, at: str, *keys: str, unique: str = "item_id") -> DataFrame:
    """The n newest rows of each group; the rest is what a clean-up would delete."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(unique)))).filter(F.col("__k") <= n).drop("__k")


def retained(rows: DataFrame, at: str, as_of: datetime, days: int = 180) -> DataFrame:
    """Rows no older than ``days``: a range on the date, so partitions and row groups are pruned."""
    return rows.filter(F.col(at) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp"))
