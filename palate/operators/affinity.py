"""Recency-weighted taste: user means, affinities over graphs and vectors, genre and age profiles, staff, audiences.

Inputs are lists (user_id, item_id, score, status, rated_at); everything is computed for all users in one pass.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import products


def scored_entries(entries: DataFrame, as_of: datetime, half_life: float | None = 0.5, floor: float = 0.05) -> DataFrame:
    """Rated entries with their age in years and recency weight w."""
    return entries.filter("score > 0").withColumn("age_years", S.age_years("rated_at", as_of)).withColumn("w", S.recency_weight("age_years", half_life, floor))


def user_mean(scored: DataFrame) -> DataFrame:
    """(user_id, mu, n): the weighted mean; null without weight."""
    return scored.groupBy("user_id").agg(F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w")).alias("mu"), F.count("*").alias("n"))


def deviations(scored: DataFrame, means: DataFrame) -> DataFrame:
    """Scored entries with d, the score's distance from its user's mean."""
    return scored.join(means.select("user_id", "mu"), "user_id").withColumn("d", F.col("score") - F.col("mu"))


def rec_affinity(dev: DataFrame, edges: DataFrame, shrink: float = 1.5, pairs: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, affinity, n): deviations of the rated titles that a title is recommended with, shrunk to zero.

    edges: (src, dst, weight); a title src is reached from rated dst. pairs: (user_id, item_id) that are asked for, if not all: then only
    their edges meet ratings.
    """
    part, mass = F.sum(F.col("weight") * F.col("w") * F.col("d")), F.sum(F.col("weight") * F.col("w"))
    links, rated = edges.select(F.col("src").alias("item_id"), "dst", "weight"), dev.select("user_id", F.col("item_id").alias("dst"), "d", "w")
    sums = [(part / (mass + shrink)).alias("affinity"), F.count("*").alias("n")]
    if pairs is None:
        return products.summed(rated, links, "user_id", "dst", "item_id", sums)
    return pairs.select("user_id", "item_id").distinct().join(links, "item_id").join(rated, ["user_id", "dst"]).groupBy("user_id", "item_id").agg(*sums)


#: Titles of all franchises up to which they are broadcast, packed by franchise (some 20 MB).
FRANCHISE_BROADCAST = 2_000_000


def with_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows met with the titles (franchise_id, item_id, ...) of their franchise. Titles come packed by franchise and are laid out where the
    rows lie, so few and large franchises neither send many rows to one task nor have what they make shuffled."""
    columns = [c for c in titles.columns if c != "franchise_id"]
    packed = titles.groupBy("franchise_id").agg(F.collect_list(F.struct(*columns)).alias("__titles"))
    if titles.count() <= FRANCHISE_BROADCAST:
        packed = F.broadcast(packed)  # counted
    return rows.join(packed, "franchise_id").withColumn("__title", F.explode("__titles")).select(*rows.columns, *(F.col("__title")[c].alias(c) for c in columns))


def franchise_affinity(dev: DataFrame, franchise: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, best_delta, has_history): the best weighted deviation among the other titles of the franchise.

    The title's own rating never counts. Two maxima a franchise are enough: where the best is the title itself, the second best holds.
    pairs: (user_id, item_id) that are asked for, if not all titles of each user's franchises.
    """
    f = franchise.select("item_id", "franchise_id")
    own = dev.select("user_id", "item_id", (F.col("d") * F.col("w")).alias("dw")).join(f, "item_id")
    if pairs is not None:
        asked = pairs.select("user_id", "item_id").distinct().join(f, "item_id")
        own = own.join(asked.select("user_id", "franchise_id").distinct(), ["user_id", "franchise_id"], "left_semi")
    order = Window.partitionBy("user_id", "franchise_id").orderBy(F.desc("dw"), "item_id")
    two = own.withColumn("k", F.row_number().over(order)).filter("k <= 2").groupBy("user_id", "franchise_id").agg(
        F.max(F.when(F.col("k") == 1, F.struct("dw", "item_id"))).alias("first"), F.max(F.when(F.col("k") == 2, F.struct("dw", "item_id"))).alias("second")
    )
    best = F.when(F.col("first.item_id") != F.col("item_id"), F.col("first.dw")).otherwise(F.col("second.dw"))
    met = with_titles(two, f) if pairs is None else two.join(asked, ["user_id", "franchise_id"])
    return met.select("user_id", "item_id", F.coalesce(best, F.lit(0.0)).alias("best_delta"), best.isNotNull().alias("has_history"))


def taste_vector(dev: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, taste): the weighted sum of deviations times item vectors, at length 1; users without mass are absent."""
    parts = dev.join(vectors.select("item_id", F.posexplode("vec").alias("pos", "x")), "item_id")
    sums = parts.groupBy("user_id", "pos").agg(F.sum(F.col("d") * F.col("w") * F.col("x")).alias("x"))
    taste = sums.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("taste"))
    return taste.filter(S.norm("taste") > 0).select("user_id", S.l2_normalize("taste").alias("taste"))


def genre_profile(scored: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, genre, share): each entry's weight split over its genres, shares summing to 1."""
    spread = scored.join(items.select("item_id", "genres"), "item_id").filter(F.size("genres") > 0)
    spread = spread.select("user_id", (F.col("w") / F.size("genres")).alias("x"), F.explode("genres").alias("genre"))
    sums = spread.groupBy("user_id", "genre").agg(F.sum("x").alias("x"))
    return sums.select("user_id", "genre", (F.col("x") / F.sum("x").over(Window.partitionBy("user_id"))).alias("share"))


def series_weight(entries: DataFrame, series: DataFrame, power: float = 1.0) -> DataFrame:
    """Entries with share: n^-power where the user has n titles of the series (titles without one stand alone)."""
    at = entries.join(series.select("item_id", "series_id"), "item_id", "left").withColumn("series_id", F.coalesce("series_id", "item_id"))
    return at.withColumn("share", F.pow(F.count("*").over(Window.partitionBy("user_id", "series_id")).cast("double"), F.lit(-float(power))))


def genre_lifts(entries: DataFrame, items: DataFrame, series: DataFrame, power: float = 1.0, least_series: int = 4) -> DataFrame:
    """(user_id, genre, lift, n_series): series-weighted genre mean over the user's mean, for genres of enough series."""
    at = series_weight(entries.filter("score > 0"), series, power)
    mean = at.groupBy("user_id").agg((F.sum(F.col("score") * F.col("share")) / F.sum("share")).alias("mu"))
    by = at.join(items.select("item_id", "genres"), "item_id").select("user_id", "series_id", "score", "share", F.explode("genres").alias("genre"))
    sums = by.groupBy("user_id", "genre").agg((F.sum(F.col("score") * F.col("share")) / F.sum("share")).alias("m"), F.count_distinct("series_id").alias("n_series"))
    return sums.filter(F.col("n_series") >= least_series).join(mean, "user_id").select("user_id", "genre", (F.col("m") - F.col("mu")).alias("lift"), "n_series")


def age_mix(scored: DataFrame, items: DataFrame, year: int, least: int = 10) -> DataFrame:
    """(user_id, mix): weight shares of five release-age buckets; null with too few dated titles."""
    at = scored.join(items.select("item_id", "season_year"), "item_id").filter("season_year is not null").withColumn("b", S.age_bucket(F.lit(year) - F.col("season_year")))
    total = F.sum("w")
    return at.groupBy("user_id").agg(F.when((F.count("*") >= least) & (total > 0), F.array(*(F.coalesce(F.sum(F.when(F.col("b") == k, F.col("w"))), F.lit(0.0)) / total for k in range(5)))).alias("mix"))


def watched_age_mix(entries: DataFrame, items: DataFrame, years: DataFrame | None = None, least: int = 10) -> DataFrame:
    """(user_id, mix): shares of the five buckets of how old titles were when the user watched them, each started title counted once.

    A habit over the whole list, so neither scores nor recency count. Planned and undated entries are left out; with fewer than ``least``
    of the others the mix is null. years: (item_id, season_year) of a stored shortlist, for titles that ``items`` does not date.
    """
    dated = items.select("item_id", "season_year")
    if years is not None:
        dated = dated.join(years.select("item_id", F.col("season_year").alias("__y")).dropDuplicates(["item_id"]), "item_id", "full").select("item_id", F.coalesce("season_year", "__y").alias("season_year"))
    started = entries.filter("status <> 'plan_to_watch' and rated_at is not null").select("user_id", "item_id", F.year("rated_at").alias("__at"))
    b = S.age_bucket(F.col("__at") - F.col("season_year"))
    at = started.join(dated.filter("season_year is not null"), "item_id").select("user_id", b.alias("b"))
    shares = F.array(*(F.count_if(F.col("b") == k) / F.count("*") for k in range(5)))
    return at.groupBy("user_id").agg(F.when(F.count("*") >= least, shares).alias("mix"))


def age_aim(mix: Column | str, fresh_weight: float) -> Column:
    """The mix that a list is held to: the user's, its share of titles under two years scaled by ``fresh_weight``. A mix of nothing else
    at weight 0 stays as it is."""
    mix = S.col(mix)
    scaled = F.transform(mix, lambda x, k: F.when(k == 0, x * fresh_weight).otherwise(x))
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(scaled, lambda x: x / total)).otherwise(mix)


def staff_affinity(pairs: DataFrame, dev: DataFrame, staff: DataFrame, shrink: float = 2.0) -> DataFrame:
    """(user_id, item_id, signal, n) of the asked pairs only: the weighted mean deviation of the user's other rated titles that share a
    person with the title, each counted once however many people they share.

    Both sides are joined on (user, person), so nothing grows with the square of a person's titles.
    """
    people = staff.select("item_id", "staff_id").distinct()
    asked = pairs.select("user_id", "item_id").distinct().join(people, "item_id")
    mine = dev.select("user_id", F.col("item_id").alias("__rated"), "d", "w").join(people.withColumnRenamed("item_id", "__rated"), "__rated")
    met = asked.join(mine, ["user_id", "staff_id"]).filter("item_id <> __rated").select("user_id", "item_id", "__rated", "d", "w").distinct()
    return met.groupBy("user_id", "item_id").agg((F.sum(F.col("d") * F.col("w")) / (F.sum("w") + shrink)).alias("signal"), F.count("*").alias("n"))


def staff_signal(dev: DataFrame, staff: DataFrame, candidates: DataFrame | None = None, shrink: float = 2.0) -> DataFrame:
    """(user_id, item_id, signal, n): weighted mean deviation of the other rated titles that share a person, each pair counted once."""
    people = staff.select("item_id", "staff_id").distinct()
    mine = people if candidates is None else people.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    pairs = mine.join(people.select(F.col("item_id").alias("rated_id"), "staff_id"), "staff_id").filter("item_id <> rated_id").select("item_id", "rated_id").distinct()
    at = dev.select("user_id", F.col("item_id").alias("rated_id"), "d", "w").join(pairs, "rated_id")
    return at.groupBy("user_id", "item_id").agg((F.sum(F.col("d") * F.col("w")) / (F.sum("w") + shrink)).alias("signal"), F.count("*").alias("n"))


def long_series_taste(entries: DataFrame, items: DataFrame, long_from: int = 50) -> DataFrame:
    """(user_id, share, lift, drop): how much of a list is long series, how it scores and how often they are dropped."""
    at = entries.join(items.select("item_id", (F.col("num_episodes") >= long_from).alias("is_long")), "item_id")
    rate = lambda c: F.avg(F.when(c, (F.col("status") == "dropped").cast("double")))
    return at.groupBy("user_id").agg(
        F.avg(F.col("is_long").cast("double")).alias("share"), F.coalesce(F.avg(F.when(F.col("is_long") & (F.col("score") > 0), F.col("score"))) - F.avg(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)).alias("lift"),
        F.coalesce(rate(F.col("is_long")) - rate(~F.col("is_long")), F.lit(0.0)).alias("drop"),
    )


def age_taste(scored: DataFrame, items: DataFrame, year: int) -> DataFrame:
    """(user_id, bucket, share, lift) of each release-age bucket a user has titles in."""
    at = scored.join(items.select("item_id", S.age_bucket(F.lit(year) - F.col("season_year")).alias("bucket")), "item_id").filter("bucket is not null")
    mu = at.groupBy("user_id").agg(F.avg("score").alias("mu"), F.count("*").alias("total"))
    by = at.groupBy("user_id", "bucket").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    return by.join(mu, "user_id").select("user_id", "bucket", (F.col("n") / F.col("total")).alias("share"), (F.col("m") - F.col("mu")).alias("lift"))


def item_opinions(entries: DataFrame, least_raters: int = 30, top: int = 1500) -> DataFrame:
    """(item_id, listed, raters, spread): how many lists hold a title and how opinions on it differ, for the most listed."""
    mean = F.avg(F.when(F.col("score") > 0, F.col("score"))).over(Window.partitionBy("user_id"))
    stats = entries.withColumn("x", F.when(F.col("score") > 0, F.col("score") - mean)).groupBy("item_id").agg(F.count("*").alias("listed"), F.count("x").alias("raters"), F.stddev_pop("x").alias("spread"))
    return stats.filter(F.col("raters") >= least_raters).orderBy(F.desc("listed"), "item_id").limit(top)


def sequel_deltas(rated: DataFrame, relation: DataFrame, shrink: float = 20.0) -> DataFrame:
    """(prequel_id, sequel_id, n, total, delta): how users rate a sequel against its predecessor, shrunk to the mean of all pairs.

    The self-join on the user keeps pairs of the relation only, so it is a join of each rating with its title's few sequels.
    """
    links = relation.filter("relation_type = 'sequel'").select(F.col("src").alias("prequel_id"), F.col("dst").alias("sequel_id"))
    first = rated.select("user_id", F.col("item_id").alias("prequel_id"), F.col("score").alias("s0")).join(links, "prequel_id")
    both = first.join(rated.select("user_id", F.col("item_id").alias("sequel_id"), F.col("score").alias("s1")), ["user_id", "sequel_id"])
    sums = both.groupBy("prequel_id", "sequel_id").agg(F.count("*").alias("n"), F.sum(F.col("s1") - F.col("s0")).alias("total"))
    overall = both.agg(F.avg(F.col("s1") - F.col("s0")).alias("g"))
    return sums.crossJoin(F.broadcast(overall)).select("prequel_id", "sequel_id", "n", "total", ((F.col("total") + shrink * F.col("g")) / (F.col("n") + shrink)).alias("delta"))  # one row


def audience_growth(entries: DataFrame, items: DataFrame, months: int = 121) -> DataFrame:
    """(month, share): the median over titles of the cumulative audience share by months since their start."""
    at = entries.join(items.select("item_id", "start_date"), "item_id").withColumn("month", F.greatest(F.floor(F.months_between("rated_at", "start_date")), F.lit(0)).cast("int"))
    cells = at.filter(F.col("month") <= months).groupBy("item_id", "month").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("item_id").orderBy("month")) / F.sum("n").over(Window.partitionBy("item_id"))
    return cells.withColumn("share", running).groupBy("month").agg(F.median("share").alias("share"), F.count("*").alias("titles"))


def implicit_entries(entries: DataFrame, offsets: dict[str, float], weight: float = 0.8) -> DataFrame:
    """Unrated entries as pseudo-ratings: the user's mean plus an offset for the status, in 1..10, at a lower weight."""
    mean = F.avg(F.when(F.col("score") > 0, F.col("score"))).over(Window.partitionBy("user_id"))
    offset = F.lit(None).cast("double")
    for status, x in offsets.items():
        offset = F.when(F.col("status") == status, F.lit(float(x))).otherwise(offset)
    rows = entries.withColumn("mean", mean).withColumn("offset", offset).filter("score = 0 and offset is not null and mean is not null")
    return rows.select("user_id", "item_id", F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("mean") + F.col("offset"))).alias("score"), F.lit(weight).alias("weight"), "rated_at")


def dismissal_entries(feedback: DataFrame, entries: DataFrame, offset: float = -1.0, weight: float = 0.4) -> DataFrame:
    """Titles marked as not interesting and not listed, as pseudo-ratings under the user's mean."""
    means = entries.filter("score > 0").groupBy("user_id").agg(F.avg("score").alias("mean"))
    last = feedback.filter("action = 'not_interested'").groupBy("user_id", "item_id").agg(F.max("created_at").alias("rated_at"))
    return last.join(entries.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").join(means, "user_id").select("user_id", "item_id", F.greatest(F.col("mean") + offset, F.lit(1.0)).alias("score"), F.lit(weight).alias("weight"), "rated_at")
