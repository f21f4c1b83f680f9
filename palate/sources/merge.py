"""Write semantics on immutable tables: each takes the stored table and what arrives, and returns the table to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .projection import INVERSE, case_map


def _empty(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.col(c).isNull() | (F.size(c) == 0) if kind.startswith(("array", "map")) else F.col(c).isNull()


def richest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key: the one with the most known columns. Rows of equal richness: by their own order of values."""
    rest = [c for c in rows.columns if c not in keys]
    comparable = [c for c in rest if not dict(rows.dtypes)[c].startswith("map")]
    known = sum((F.when(_empty(rows, c), 0).otherwise(1) for c in rest), F.lit(0))
    best = Window.partitionBy(*keys).orderBy(F.desc("__known"), *(F.desc_nulls_last(c) for c in comparable))
    return rows.withColumn("__known", known).withColumn("__k", F.row_number().over(best)).filter("__k = 1").drop("__known", "__k")


def coalescing_upsert(stored: DataFrame, arriving: DataFrame, *keys: str) -> DataFrame:
    """New values win where there are any: null and empty arrays mean "not in this payload" and change nothing."""
    new = richest(arriving, *keys)
    rest = [c for c in stored.columns if c not in keys]
    both = stored.alias("o").join(new.alias("n"), list(keys), "full_outer")
    value = lambda c: F.when(_blank(new, c, "n"), F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).otherwise(F.col(f"n.{c}"))
    return both.select(*keys, *((value(c) if c in new.columns else F.col(f"o.{c}")).alias(c) for c in rest))


def _blank(df: DataFrame, c: str, alias: str) -> Column:
    full = F.col(f"{alias}.{c}")
    return full.isNull() | (F.size(full) == 0) if dict(df.dtypes)[c].startswith(("array", "map")) else full.isNull()


def replace_set(stored: DataFrame, arriving: DataFrame, *keys: str) -> DataFrame:
    """All rows of the arriving keys are replaced."""
    return stored.join(arriving.select(*keys).distinct(), list(keys), "left_anti").unionByName(arriving)


def insert_new(stored: DataFrame, arriving: DataFrame, *keys: str) -> DataFrame:
    """Rows of unknown keys are added, known ones stay."""
    return stored.unionByName(arriving.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"))


def upsert_edges(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(src, dst, provider, votes, weight): both directions, the larger votes and weight stay."""
    cols = ["src", "dst", "provider", "votes", "weight"]
    back = arriving.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "provider", "votes", "weight")
    every = stored.select(*cols).unionByName(arriving.select(*cols)).unionByName(back).filter("src <> dst")
    return every.groupBy("src", "dst", "provider").agg(F.max("votes").alias("votes"), F.max("weight").alias("weight"))


def upsert_relations(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(src, dst, relation_type, provider) with the inverse of each link."""
    back = arriving.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce(case_map("relation_type", INVERSE), F.lit("other")).alias("relation_type"), "provider")
    return stored.unionByName(arriving.select(*stored.columns)).unionByName(back.select(*stored.columns)).distinct()


def replace_lists(stored: DataFrame, arriving: DataFrame, least: int = 20, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(table, refused users): users' lists are replaced, unless a stored list of ``least`` entries would shrink under ``share`` of it.

    A fetch that broke off must not wipe a list; the refused keep theirs.
    """
    before, now = (df.groupBy("user_id").agg(F.count("*").alias(n)) for df, n in ((stored, "before"), (arriving, "now")))
    refused = now.join(before, "user_id").filter((F.col("before") >= least) & (F.col("now") < share * F.col("before"))).select("user_id")
    taken = arriving.join(refused, "user_id", "left_anti")
    return replace_set(stored, taken, "user_id"), refused


def list_changes(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """(user_id, item_id, status, score, at): a row for each entry that came, went or changed in status or score. Removal: null status, score 0."""
    both = old.select("user_id", "item_id", F.struct("status", "score").alias("o")).join(new.select("user_id", "item_id", F.struct("status", "score").alias("n")), ["user_id", "item_id"], "full_outer")
    return both.filter(~F.col("o").eqNullSafe(F.col("n"))).select("user_id", "item_id", F.col("n.status").alias("status"), F.coalesce("n.score", F.lit(0)).alias("score"), at.alias("at"))


def exclusive_update(stored: DataFrame, arriving: DataFrame, key: str, unique: str) -> DataFrame:
    """Assign a unique secondary id: an arriving one is taken from whichever row holds it, then given to its new row."""
    new = arriving.filter(F.col(unique).isNotNull()).dropDuplicates([unique]).select(key, F.col(unique).alias("__new"))
    taken = new.select(F.col("__new").alias(unique), F.lit(True).alias("__taken"))
    rows = stored.join(taken, unique, "left").join(new, key, "left")
    value = F.when(F.col("__new").isNotNull(), F.col("__new")).when(F.coalesce("__taken", F.lit(False)), F.lit(None)).otherwise(F.col(unique))
    return rows.withColumn(unique, value).select(*stored.columns)


def counted(stored: DataFrame, arriving: DataFrame, *keys: str) -> DataFrame:
    """Daily counters (keys, n, rank, last_at): counts add up, the newest known rank stays."""
    every = stored.select(*keys, "n", "rank", "last_at").unionByName(arriving.select(*keys, "n", "rank", "last_at"))
    return every.groupBy(*keys).agg(F.sum("n").alias("n"), F.max_by("rank", F.when(F.col("rank").isNotNull(), F.col("last_at"))).alias("rank"), F.max("last_at").alias("last_at"))


def unordered_pairs(rows: DataFrame, a: str = "user_a", b: str = "user_b") -> DataFrame:
    """One row for each unordered pair: the earliest."""
    return rows.groupBy(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).agg(F.min("created_at").alias("created_at"))


def rotated(sample: DataFrame, as_of: Column, n: int, days: int) -> DataFrame:
    """The n longest-held members of a sample that are older than ``days``: those to fetch anew."""
    return sample.filter(F.col("fetched_at") < as_of - F.make_dt_interval(F.lit(days))).orderBy("fetched_at", "name_hash").limit(n)


def discovered(names: DataFrame, known: DataFrame, excluded: DataFrame) -> DataFrame:
    """(name_hash, state) of names not known yet; those that asked to be left out are marked so."""
    new = names.select(F.sha2(F.lower(F.trim("name")), 256).alias("name_hash")).distinct().join(known.select("name_hash"), "name_hash", "left_anti")
    return new.join(excluded.select("name_hash", F.lit(True).alias("out")), "name_hash", "left").select("name_hash", F.when(F.col("out"), "excluded").otherwise("pending").alias("state"))


def erased(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Every user-keyed table without the given users."""
    return {k: t.join(users.select("user_id"), "user_id", "left_anti") for k, t in tables.items()}


def left_sample(ratings: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """The sampled ratings without those of the named users (matched by hash)."""
    gone = members.join(names.select(F.sha2(F.lower(F.trim("name")), 256).alias("name_hash")), "name_hash", "left_semi").select("user_id")
    return ratings.join(gone, "user_id", "left_anti")


def saved_surface(stored: DataFrame, built: DataFrame) -> DataFrame:
    """The result cache after a build: lists of the built (user_id, surface) replaced, others as they were."""
    return replace_set(stored, built, "user_id", "surface")


def impressions(built: DataFrame, at: Column, top: int = 50) -> DataFrame:
    """(user_id, surface, item_id, rank, predicted, shown_at): what a build appends to the log of shown titles."""
    return built.filter(F.col("position") <= top).select("user_id", "surface", "item_id", F.col("position").alias("rank"), F.col("value").alias("predicted"), at.alias("shown_at"))


def stamped(stored: DataFrame, arriving: DataFrame, stamp: str, at: Column, key: str = "item_id") -> DataFrame:
    """The table with ``stamp`` set to ``at`` for the keys that arrive."""
    new = arriving.select(key).distinct().withColumn("__at", at)
    return stored.join(new, key, "left").withColumn(stamp, F.coalesce("__at", stamp)).drop("__at").select(*stored.columns)


def mirrored(stored: DataFrame, writes: DataFrame, at: Column) -> DataFrame:
    """A local copy of the lists after single writes (user_id, item_id, status, score, episodes): a null status removes the entry, a null
    score keeps the stored one, episodes never fall. stored: (user_id, item_id, status, score, episodes, updated_at)."""
    keys = ["user_id", "item_id"]
    both = stored.alias("o").join(writes.withColumn("here", F.lit(True)).alias("n"), keys, "full_outer").filter("n.here is null or n.status is not null")
    kept = F.col("n.here").isNull()
    return both.select(
        *keys, F.when(kept, F.col("o.status")).otherwise(F.col("n.status")).alias("status"), F.when(kept, F.col("o.score")).otherwise(F.coalesce("n.score", "o.score", F.lit(0))).alias("score"),
        F.greatest(F.col("o.episodes"), F.col("n.episodes")).alias("episodes"), F.when(kept, F.col("o.updated_at")).otherwise(at).alias("updated_at"),
    )


def resumed(cursor: DataFrame, work: DataFrame, stage: str, order: str) -> DataFrame:
    """The work left of a stage: what comes after the last place that its cursor (stage, done) holds; all of it without one."""
    done = cursor.filter(F.col("stage") == stage).agg(F.max("done").alias("__done"))
    return work.crossJoin(F.broadcast(done)).filter(F.col("__done").isNull() | (F.col(order) > F.col("__done"))).drop("__done")  # one row


def undone(actions: DataFrame, undo: DataFrame) -> DataFrame:
    """An action log without the newest action of each (user_id, item_id, action) that is taken back."""
    newest = Window.partitionBy("user_id", "item_id", "action").orderBy(F.desc("created_at"))
    at = actions.withColumn("__k", F.row_number().over(newest)).join(undo.select("user_id", "item_id", "action").distinct().withColumn("__gone", F.lit(True)), ["user_id", "item_id", "action"], "left")
    return at.filter(F.col("__gone").isNull() | (F.col("__k") > 1)).drop("__k", "__gone")


def missing(ids: DataFrame, stamped: DataFrame, as_of: Column | None = None, max_days: int | None = None) -> DataFrame:
    """Ids (item_id, ord) without a stamp, or with one older than ``max_days``, each once at its first place."""
    fresh = stamped.filter(F.col("stamp").isNotNull()) if max_days is None else stamped.filter(F.col("stamp") >= as_of - F.make_dt_interval(F.lit(max_days)))
    return ids.groupBy("item_id").agg(F.min("ord").alias("ord")).join(fresh.select("item_id"), "item_id", "left_anti")


def by_priority(*sources: DataFrame, key: str = "item_id") -> DataFrame:
    """The union of catalogues; a key comes from the first source that has it."""
    every = None
    for k, s in enumerate(sources):
        s = s.withColumn("__p", F.lit(k))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("__p", *(c for c in sources[0].columns if c != key and not dict(sources[0].dtypes)[c].startswith(("array", "map"))))
    return every.withColumn("__k", F.row_number().over(best)).filter("__k = 1").drop("__k", "__p")


def stale(items: DataFrame, entries: DataFrame, as_of: Column, days: int, scope: str = "all", recent_days: int = 120, least_members: int = 1000) -> DataFrame:
    """(item_id) whose ``fetched_at`` is null or older than ``days``, the most listed first. scope ``recent``: airing, announced or begun in
    the last ``recent_days``, and with enough members or on a list."""
    due = items.filter(F.col("fetched_at").isNull() | (F.col("fetched_at") < as_of - F.make_dt_interval(F.lit(days))))
    if scope == "recent":
        since = F.date_sub(as_of.cast("date"), recent_days)
        moving = F.col("status").isin("currently_airing", "not_yet_aired") | (F.col("start_date") >= since)
        listed = entries.select("item_id").distinct().withColumn("__listed", F.lit(True))
        due = due.filter(moving).join(listed, "item_id", "left").filter((F.coalesce("members", F.lit(0)) >= least_members) | F.col("__listed").isNotNull())
    return due.orderBy(F.desc_nulls_last("members"), "item_id").select("item_id")


def upcoming_unlinked(items: DataFrame, least_members: int = 1000) -> DataFrame:
    """(item_id): announced titles of some audience whose relations were never fetched, the most awaited first."""
    rows = items.filter((F.col("status") == "not_yet_aired") & F.col("graph_fetched_at").isNull() & (F.coalesce("members", F.lit(0)) >= least_members))
    return rows.orderBy(F.desc("members"), "item_id").select("item_id")


def details_pending(items: DataFrame, least_members: int = 1000) -> DataFrame:
    """(item_id): titles of a real audience without their graph, or with a graph but without statistics, by popularity."""
    lack = F.col("graph_fetched_at").isNull() | F.col("status_dist").isNull()
    return items.filter(lack & (F.coalesce("members", F.lit(0)) >= least_members)).orderBy(F.asc_nulls_last("popularity"), "item_id").select("item_id")


def second_source_pending(items: DataFrame, entries: DataFrame, least_scorers: int) -> DataFrame:
    """(item_id, listed) never fetched from the second source that enough users scored or that are listed: listed ones first, then by popularity."""
    listed = entries.select("item_id").distinct().withColumn("listed", F.lit(True))
    rows = items.filter(F.col("fetched_at").isNull()).join(listed, "item_id", "left").fillna({"listed": False})
    return rows.filter((F.coalesce("scorers", F.lit(0)) >= least_scorers) | F.col("listed")).orderBy(F.desc("listed"), F.asc_nulls_last("popularity"), "item_id").select("item_id", "listed")


def list_needs(entries: DataFrame, graph: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, listed, rated, graph_missing, tags_missing): per user how much of the list still lacks its graph, and of what is rated its tags."""
    at = entries.join(graph.select("item_id").distinct().withColumn("g", F.lit(1)), "item_id", "left").join(tags.select("item_id").distinct().withColumn("t", F.lit(1)), "item_id", "left")
    rated = F.col("score") > 0
    return at.groupBy("user_id").agg(F.count("*").alias("listed"), F.count_if(rated).alias("rated"), F.count_if(F.col("g").isNull()).alias("graph_missing"), F.count_if(rated & F.col("t").isNull()).alias("tags_missing"))
