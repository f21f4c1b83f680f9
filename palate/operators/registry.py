"""Model registry and gates: versions with one active, what a fit must show before it serves, freshness, quality words."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..settings import Settings


def settings_fingerprint(s: Settings, *names: str) -> str:
    """A digest of the settings a ranker was trained under; a ranker serves only under the same."""
    import hashlib

    values = asdict(s)
    return hashlib.sha256(json.dumps({k: values[k] for k in sorted(names or values)}, sort_keys=True).encode()).hexdigest()


def activated(models: DataFrame, model_id: int, kind: str) -> DataFrame:
    """The registry (id, kind, active, made_at, ...) with one active version of a kind."""
    return models.withColumn("active", F.when(F.col("kind") == kind, F.col("id") == model_id).otherwise(F.col("active")))


def fallbacks_kept(models: DataFrame, keep: int = 2) -> DataFrame:
    """The active version of each kind and its ``keep`` newest others; the rest may go."""
    place = F.row_number().over(Window.partitionBy("kind", "active").orderBy(F.desc("made_at"), F.desc("id")))
    return models.withColumn("__k", place).filter(F.col("active") | (F.col("__k") <= keep)).drop("__k")


def usable_ranker(rankers: DataFrame, surface: str, fingerprint: str) -> DataFrame:
    """The newest active ranker of a surface whose settings are the running ones."""
    rows = rankers.filter(F.col("active") & (F.col("surface") == surface) & (F.col("fingerprint") == fingerprint))
    return rows.orderBy(F.desc("made_at"), F.desc("id")).limit(1)


def gate(new: DataFrame, old: DataFrame, metrics: tuple[str, ...], tolerance: float = 0.005) -> DataFrame:
    """One row a metric (metric, change, ok): a fit passes where it loses no more than ``tolerance`` on the same users."""
    both = new.select("user_id", *(F.col(m).alias(f"n_{m}") for m in metrics)).join(old.select("user_id", *(F.col(m).alias(f"o_{m}") for m in metrics)), "user_id")
    means = both.agg(*(F.avg(F.col(f"n_{m}") - F.col(f"o_{m}")).alias(m) for m in metrics))
    rows = means.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("change")) for m in metrics))).alias("r")).select("r.*")
    return rows.withColumn("ok", F.coalesce(F.col("change") >= -tolerance, F.lit(False)))


def exam_users(entries: DataFrame, most: int = 3000, seed: str = "exam") -> DataFrame:
    """A stated number of users, the same ones at every fit: those of the smallest hashes."""
    return entries.select("user_id").distinct().orderBy(S.unit_hash(F.lit(seed), "user_id"), "user_id").limit(most)


def own_line_usable(rho: Column | str, slope: Column | str) -> Column:
    """A user's own calibration serves from a rank correlation of .3 and a slope of .5."""
    return (S.col(rho) >= 0.3) & (S.col(slope) >= 0.5)


def outgrown(n_now: Column | str, n_built: Column | str) -> Column:
    """A model is outgrown once the list is half again as long as at its build, ten entries at least."""
    return S.col(n_now) >= F.greatest(S.col(n_built) * 1.5, S.col(n_built) + 10)


def quality_words(rho: Column | str) -> Column:
    """How well predictions order a user's ratings, in words."""
    r = S.col(rho)
    return F.when(r.isNull(), "unknown").when(r >= 0.6, "very well").when(r >= 0.45, "well").when(r >= 0.3, "fairly").otherwise("poorly")


def merged_accounts(sessions: DataFrame) -> DataFrame:
    """(stable_id, account_id, name): one account a stable id, by its newest session; renames follow it."""
    newest = Window.partitionBy("stable_id").orderBy(F.desc("seen_at"), F.desc("account_id"))
    return sessions.filter("stable_id is not null").withColumn("__k", F.row_number().over(newest)).filter("__k = 1").select("stable_id", "account_id", "name")


def graph_targets(items: DataFrame, entries: DataFrame, limit: int, only_missing: bool = True) -> DataFrame:
    """(item_id, listed) to be fetched next: listed titles first, then the most known, those without a stamp only."""
    listed = entries.select("item_id").distinct().withColumn("listed", F.lit(True))
    rows = items.join(listed, "item_id", "left").fillna({"listed": False})
    rows = rows.filter(F.col("fetched_at").isNull()) if only_missing else rows
    return rows.orderBy(F.desc("listed"), F.asc_nulls_last("popularity"), "item_id").limit(limit).select("item_id", "listed")


def undated_last(rows: DataFrame) -> DataFrame:
    """Rank by start date, undated titles last, then by score and prediction."""
    order = Window.partitionBy("user_id").orderBy(F.coalesce("start_date", F.lit("9999-01-01").cast("date")), F.desc("after_score"), "item_id")
    return rows.withColumn("rank", F.row_number().over(order))


def user_neighbours(ratings: DataFrame, users: DataFrame, k: int = 50, shrink: float = 10.0) -> DataFrame:
    """(user_id, other_id, sim, co, rank): users that rate alike (centred cosine, shrunk by common titles), for stated users."""
    centred = ratings.withColumn("c", F.col("score") - F.avg("score").over(Window.partitionBy("user_id")))
    norms = centred.groupBy("user_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    mine = centred.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "item_id", F.col("c").alias("x"))
    pairs = mine.join(centred.select(F.col("user_id").alias("other_id"), "item_id", F.col("c").alias("y")), "item_id").filter("user_id <> other_id").groupBy("user_id", "other_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count("*").alias("co"))
    sims = pairs.join(norms.withColumnRenamed("norm", "nu"), "user_id").join(norms.select(F.col("user_id").alias("other_id"), F.col("norm").alias("no")), "other_id")
    sims = sims.withColumn("sim", F.try_divide("dot", F.col("nu") * F.col("no")) * F.col("co") / (F.col("co") + shrink)).filter("sim > 0")
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("sim", 9)), "other_id"))).filter(F.col("rank") <= k).select("user_id", "other_id", "sim", "co", "rank")  # equal but for the order of a sum: the smaller id


def evidence_lines(picks: DataFrame, values: DataFrame, evidence: DataFrame, top: int = 4) -> DataFrame:
    """(user_id, item_id, kind, name, z, rank): a pick's attributes that say most, by clear group evidence. values: (item_id, kind, name)."""
    at = picks.select("user_id", "item_id").join(values.select("item_id", "kind", "name").distinct(), "item_id").join(evidence.filter("clear").select("user_id", "kind", "name", "z"), ["user_id", "kind", "name"])
    return at.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy(F.desc(F.abs("z")), "kind", "name"))).filter(F.col("rank") <= top).select("user_id", "item_id", "kind", "name", "z", "rank")


def memory_bonus(rows: DataFrame, mix: float = 0.5, cap: float = 0.15) -> DataFrame:
    """Add bonus: what a model of longer memory (column long_key) says beyond the key, as standard scores, in the key's spread, capped."""
    w = Window.partitionBy("user_id")
    zed = lambda c: F.when(F.stddev_pop(c).over(w) > 1e-9, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(F.lit(0.0))
    raw = mix * (zed("long_key") - zed("key")) * F.coalesce(F.stddev_pop("key").over(w), F.lit(0.0))
    return rows.withColumn("bonus", F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)))


def job_state(lines: DataFrame, max_hours: float, as_of: Column) -> DataFrame:
    """(started_at, failed, late) from a log (at, line): lines since the last start marker, whether any tells a failure, whether it is old."""
    start = lines.agg(F.max(F.when(F.col("line").startswith("== start"), F.col("at"))).alias("started_at"))
    since = lines.crossJoin(F.broadcast(start)).filter(F.col("at") >= F.col("started_at"))  # one row
    late = (F.unix_timestamp(as_of) - F.unix_timestamp("started_at")) / 3600 > max_hours
    return since.groupBy("started_at").agg(F.bool_or(F.col("line").rlike("(?i)error|failed|traceback")).alias("failed")).withColumn("late", late)


def list_version(entries: DataFrame) -> DataFrame:
    """(user_id, entries, newest): what tells whether a cached model is of the list as it is now."""
    return entries.groupBy("user_id").agg(F.count("*").alias("entries"), F.max("rated_at").alias("newest"))


def newest_run(runs: DataFrame) -> DataFrame:
    """The last run of each user (user_id, id, made_at, ...)."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("made_at"), F.desc("id")))
    return runs.withColumn("__k", place).filter("__k = 1").drop("__k")


def partners(pairs: DataFrame) -> DataFrame:
    """(user_id, other_id, state): each pair (inviter, invitee, status) as either side sees it: partner, outgoing or incoming."""
    side = lambda me, other, waiting: pairs.select(F.col(me).alias("user_id"), F.col(other).alias("other_id"), F.when(F.col("status") == "accepted", "partner").otherwise(waiting).alias("state"))
    return side("inviter", "invitee", "outgoing").unionByName(side("invitee", "inviter", "incoming"))
