"""Evaluation and statistics: temporal hold-outs, rank metrics, ranges, multiple tests, paired comparisons, group evidence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def temporal_split(rated: DataFrame, share: float = 0.2, least: int = 3, bulk: float = 0.5) -> DataFrame:
    """Add held: a user's newest fifth (at least ``least``). Lists imported in bulk (over half on one day) are split by hash instead."""
    days = rated.groupBy("user_id", F.to_date("rated_at").alias("day")).agg(F.count("*").alias("c")).groupBy("user_id").agg((F.max("c") / F.sum("c") > bulk).alias("bulk"), F.sum("c").alias("n"))
    at = rated.join(days, "user_id")
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("bulk"), S.unit_hash("user_id", "item_id")), F.desc("rated_at"), "item_id")
    held = F.greatest(F.lit(least), F.floor(F.col("n") * share).cast("int"))
    return at.withColumn("held", F.row_number().over(order) <= F.least(held, F.col("n") - 1)).drop("bulk", "n")


def newest_holdout(rated: DataFrame, h: int = 5) -> DataFrame:
    """Add held: a user's h newest ratings."""
    return rated.withColumn("held", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("rated_at"), F.desc("item_id"))) <= h)


def folds(rated: DataFrame, k: int = 5, seed: str = "fold") -> DataFrame:
    return rated.withColumn("fold", F.floor(S.unit_hash(F.lit(seed), "user_id", "item_id") * k).cast("int"))


def average_rank(value: str, *partition: str) -> Column:
    """Ranks from 1, ties at their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def spearman(pairs: DataFrame, a: str = "prediction", b: str = "truth", key: str = "user_id") -> DataFrame:
    """(key, rho, n): rank correlation; 0 for fewer than three pairs or a constant side."""
    ranked = pairs.select(key, average_rank(a, key).alias("ra"), average_rank(b, key).alias("rb"))
    flat = (F.count("*") < 3) | (F.stddev_pop("ra") == 0) | (F.stddev_pop("rb") == 0)
    cov = F.avg(F.col("ra") * F.col("rb")) - F.avg("ra") * F.avg("rb")
    return ranked.groupBy(key).agg(F.when(flat, F.lit(0.0)).otherwise(F.try_divide(cov, F.stddev_pop("ra") * F.stddev_pop("rb"))).alias("rho"), F.count("*").alias("n"))


def ndcg(pairs: DataFrame, k: int = 10, a: str = "prediction", b: str = "truth", key: str = "user_id", item: str = "item_id") -> DataFrame:
    """(key, ndcg) with gains 2^truth - 1; 0 without any gain."""
    place = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(c), item))
    rows = pairs.withColumns({"__p": place(a), "__i": place(b)})
    part = lambda p: F.sum(F.when(F.col(p) <= k, (F.pow(F.lit(2.0), F.col(b)) - 1) / F.log2(F.col(p) + 1.0)).otherwise(0.0))
    return rows.groupBy(key).agg(F.coalesce(F.try_divide(part("__p"), part("__i")), F.lit(0.0)).alias("ndcg"))


def error(pairs: DataFrame, key: str = "user_id") -> DataFrame:
    e = F.col("prediction") - F.col("truth")
    return pairs.groupBy(key).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.count("*").alias("n"))


def propensity(entries: DataFrame) -> DataFrame:
    """(item_id, propensity): the smoothed share of users that list a title."""
    users = entries.agg(F.count_distinct("user_id").alias("users"))
    return entries.groupBy("item_id").agg(F.count("*").alias("c")).crossJoin(F.broadcast(users)).select("item_id", ((F.col("c") + 1) / (F.col("users") + 2)).alias("propensity"))  # one row


def list_metrics(lists: DataFrame, truth: DataFrame, prop: DataFrame, k: int = 50, top: int = 10) -> DataFrame:
    """(user_id, recall, ips_recall, hit, bad): of held-out liked titles those in a list's first k, also weighed by 1 / propensity;
    shares of liked and disliked titles in the first ``top``. truth: (user_id, item_id, liked, disliked)."""
    weighed = truth.join(prop, "item_id", "left").withColumn("iw", 1 / F.greatest(F.coalesce("propensity", F.lit(1.0)), F.lit(1e-6)))
    at = weighed.join(lists.select("user_id", "item_id", "position"), ["user_id", "item_id"], "left")
    good, found = F.col("liked"), F.coalesce(F.col("position") <= k, F.lit(False))
    first = F.coalesce(F.col("position") <= top, F.lit(False))
    count = lambda c, x=F.lit(1.0): F.sum(F.when(c, x).otherwise(0.0))
    return at.groupBy("user_id").agg(
        F.coalesce(F.try_divide(count(good & found), count(good)), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(count(good & found, F.col("iw")), count(good, F.col("iw"))), F.lit(0.0)).alias("ips_recall"),
        (count(good & first) / top).alias("hit"), (count(F.col("disliked") & first) / top).alias("bad"),
    )


def mix_gap(lists: DataFrame, items: DataFrame, mix: DataFrame, year: int) -> DataFrame:
    """(user_id, gap): total-variation distance of a list's release-age mix from the user's."""
    at = lists.join(items.select("item_id", S.age_bucket(F.lit(year) - F.col("season_year")).alias("b")), "item_id").filter("b is not null")
    mine = at.groupBy("user_id").agg(F.array(*(F.avg((F.col("b") == k).cast("double")) for k in range(5))).alias("own"))
    return mine.join(mix.filter("mix is not null"), "user_id").select("user_id", (F.aggregate(F.zip_with("own", "mix", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 2).alias("gap"))


def list_overlap(lists: DataFrame, top: int = 20, per_item: int | None = None) -> DataFrame:
    """(a, b, jaccard) of users whose first ``top`` titles share any. Users meet through shared titles only."""
    head = lists.filter(F.col("position") <= top).select("user_id", "item_id")
    if per_item:  # a stated sample of users a title, for a mean over pairs
        head = head.filter(S.unit_hash("user_id") < F.lit(float(per_item)))
    n = head.groupBy("user_id").agg(F.count("*").alias("n"))
    both = head.select(F.col("user_id").alias("a"), "item_id").join(head.select(F.col("user_id").alias("b"), "item_id"), "item_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    return both.join(n.select(F.col("user_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("user_id").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


QUANTILES = tuple(k / 20 for k in range(21))


def residual_quantiles(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, q): 21 quantiles of truth less prediction, linearly interpolated, to three decimals."""
    q = F.percentile(F.col("truth") - F.col("prediction"), F.array(*map(F.lit, QUANTILES)))
    return pairs.groupBy(*keys).agg(F.transform(q, lambda x: F.round(x, 3)).alias("q"))


def rating_chances(prediction: Column | str, q: Column | str) -> Column:
    """The chances of the ratings 1 to 10: the residual distribution, known at 21 quantiles and linear between them, cut at the halves."""
    p, q = S.col(prediction), S.col(q)

    def below(rating: float) -> Column:
        x = F.lit(rating + 0.5) - p
        at = F.size(F.filter(q, lambda v: v <= x))
        low, high = F.get(q, at - 1), F.get(q, at)
        return F.when(at == 0, 0.0).when(at == len(QUANTILES), 1.0).otherwise((at - 1 + (x - low) / (high - low)) / (len(QUANTILES) - 1))

    edges = F.array(F.lit(0.0), *(below(k) for k in range(1, 10)), F.lit(1.0))
    return F.transform(F.array(edges), lambda e: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.get(e, k + 1) - F.get(e, k)))[0]


#: All runs of neighbouring ratings, as places from 0.
RUNS = tuple((a, b) for a in range(10) for b in range(a, 10))


def likely_ratings(rows: DataFrame, mass: float = 0.5) -> DataFrame:
    """Add low, high and p_high: the shortest run of ratings with the likeliest one in it that holds ``mass``, and the chance of 9 or more.

    Of the runs of equal length the one that holds most, then the higher one. All 55 runs are looked at. rows: prediction, q.
    """
    p = F.col("__p")
    mode = F.array_position(p, F.array_max(p)) - 1
    upto = [F.lit(0.0)]
    for k in range(10):
        upto.append(upto[-1] + F.get(p, F.lit(k)))
    held = lambda a, b: F.round(upto[b + 1] - upto[a], 9)
    runs = F.array(*(F.when((held(a, b) >= mass) & mode.between(a, b), F.struct(F.lit(b - a).alias("n"), (-held(a, b)).alias("m"), F.lit(-a).alias("a"))) for a, b in RUNS))
    best = rows.withColumn("__p", rating_chances("prediction", "q")).withColumn("__r", F.array_min(F.filter(runs, lambda x: x.isNotNull())))
    out = best.withColumns({"low": (1 - F.col("__r.a")).cast("int"), "high": (1 - F.col("__r.a") + F.col("__r.n")).cast("int"), "p_high": F.get(p, F.lit(8)) + F.get(p, F.lit(9))})
    return out.drop("__p", "__r")


def range_report(pairs: DataFrame, quantiles: DataFrame, key: str = "user_id", low: int = 2, high: int = 18) -> DataFrame:
    """(key, n, covered): the share of ratings between two of 21 error quantiles (one row, q) of their predictions; 10 and 90 in 100."""
    at = pairs.crossJoin(F.broadcast(quantiles.select("q")))  # one row
    inside = F.col("truth").between(F.col("prediction") + F.get("q", F.lit(low)), F.col("prediction") + F.get("q", F.lit(high)))
    return at.groupBy(key).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("covered"))


def age_recall(lists: DataFrame, truth: DataFrame, items: DataFrame, year: int, k: int = 50, least: int = 2) -> DataFrame:
    """(user_id, recall_new, recall_old): of the liked titles under two years of age, and of the older ones, those in a list's first ``k``;
    null under ``least`` such titles. truth: (user_id, item_id) of liked titles."""
    bucket = S.age_bucket(F.lit(year) - F.col("season_year"))
    at = truth.join(items.select("item_id", (F.coalesce(bucket, F.lit(0)) == 0).alias("new"), F.col("season_year").isNotNull().alias("dated")), "item_id").filter("dated")
    at = at.join(lists.filter(F.col("position") <= k).select("user_id", "item_id", F.lit(1.0).alias("found")), ["user_id", "item_id"], "left")
    share = lambda c: F.when(F.count_if(c) >= least, F.sum(F.when(c, F.coalesce("found", F.lit(0.0)))) / F.count_if(c))
    return at.groupBy("user_id").agg(share(F.col("new")).alias("recall_new"), share(~F.col("new")).alias("recall_old"))


def range_coverage(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.count("*").alias("n"))


def benjamini_hochberg(tests: DataFrame, q: float = 0.1, key: str = "family", p: str = "p", item: str = "name") -> DataFrame:
    """Add keep: step-up control of the false discovery rate inside each family."""
    w = Window.partitionBy(key)
    ranked = tests.withColumn("__r", F.row_number().over(w.orderBy(p, item))).withColumn("__m", F.count("*").over(w))
    last = F.max(F.when(F.col(p) <= q * F.col("__r") / F.col("__m"), F.col("__r"))).over(w)
    return ranked.withColumn("keep", F.col("__r") <= F.coalesce(last, F.lit(0))).drop("__r", "__m")


def holm(tests: DataFrame, alpha: float = 0.05, key: str = "family", p: str = "p", item: str = "name") -> DataFrame:
    """Add keep: step-down control of the family-wise error; the first failure stops all that follow."""
    w = Window.partitionBy(key)
    ranked = tests.withColumn("__r", F.row_number().over(w.orderBy(p, item))).withColumn("__m", F.count("*").over(w))
    fail = F.min(F.when(F.col(p) > alpha / (F.col("__m") - F.col("__r") + 1), F.col("__r"))).over(w)
    return ranked.withColumn("keep", F.coalesce(F.col("__r") < fail, F.lit(True))).drop("__r", "__m")


def paired(a: DataFrame, b: DataFrame, metric: str, key: str = "user_id") -> DataFrame:
    """One row (mean, se, z, p, n) of the change from a to b over the same users; the normal tail."""
    d = a.select(key, F.col(metric).alias("x")).join(b.select(key, F.col(metric).alias("y")), key).select((F.col("y") - F.col("x")).alias("d"))
    out = d.agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
    return out.withColumn("z", F.try_divide("mean", "se")).withColumn("p", 2 * normal_tail(F.abs("z")))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by a continued fraction past 3 and a series before, within 1e-9."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    far = z
    for k in range(40, 0, -1):
        far = z + F.lit(float(k)) / far
    near, term = F.lit(0.0), z
    for k in range(60):
        near = near + term if k else term
        term = term * z * z / (2 * k + 3)
    return F.when(z < 3, 0.5 - density * near).otherwise(density / F.greatest(far, F.lit(1e-9)))


def period_change(rows: DataFrame, metric: str = "positive") -> DataFrame:
    """One row (change, se, users): users' mean after less before, over users with both. rows: (user_id, after, metric)."""
    each = rows.groupBy("user_id").agg(F.avg(F.when(F.col("after"), F.col(metric).cast("double"))).alias("y"), F.avg(F.when(~F.col("after"), F.col(metric).cast("double"))).alias("x")).filter("x is not null and y is not null")
    d = F.col("y") - F.col("x")
    return each.agg(F.avg(d).alias("change"), F.coalesce(F.stddev_samp(d) / F.sqrt(F.count("*")), F.lit(0.0)).alias("se"), F.count("*").alias("users"))


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of Student's t by the incomplete beta function (a continued fraction, for all values at once)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    a, b, z = df / 2, np.full(len(df), 0.5), df / (df + t * t)
    flip = z > (a + 1) / (a + b + 2)
    p, r, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - z, z)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    log_front = gamma(p + r) - gamma(p) - gamma(r) + p * np.log(np.maximum(y, 1e-300)) + r * np.log(np.maximum(1 - y, 1e-300)) if len(t) else np.zeros(0)
    f = np.ones(len(t))
    for k in range(120, 0, -1):  # the continued fraction, from its far end
        m = k // 2
        step = m * (r - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) if k % 2 == 0 else -(p + m) * (p + r + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        f = 1 + step / f
    beta = np.exp(log_front) / p / f
    return 0.5 * np.where(flip, 1 - beta, beta)


def two_sided_p(z: str, n: str) -> Column:
    """Two-sided p of a mean of n values, z standard errors off, on Student's t; 1 for a single value."""

    @F.pandas_udf("double")
    def p(z: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(np.where(n > 1, np.minimum(1.0, 2 * student_tail(z.abs().to_numpy(float), np.maximum(n.to_numpy(float) - 1, 1))), 1.0))

    return p(z, n)


def group_evidence(values: DataFrame, mu: DataFrame, least: int = 4, z_least: float = 2.0, floor: float = 0.5, fdr: float = 0.1) -> DataFrame:
    """(user_id, kind, name, series, mean, lift, z, p, clear): groups of series against the user's mean, corrected together per user and kind.

    values: (user_id, series_id, kind, name, score); a series counts once, by its mean; mu: (user_id, mu).
    """
    by = values.groupBy("user_id", "series_id", "kind", "name").agg(F.avg("score").alias("score"))
    g = by.groupBy("user_id", "kind", "name").agg(F.count("*").alias("series"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd")).filter(F.col("series") >= least).join(mu.select("user_id", "mu"), "user_id")
    g = g.withColumn("lift", F.col("mean") - F.col("mu")).withColumn("z", F.col("lift") / (F.greatest(F.col("sd"), F.lit(floor)) / F.sqrt("series")))
    g = benjamini_hochberg(g.withColumn("p", two_sided_p("z", "series")).withColumn("family", F.concat_ws("|", F.col("user_id").cast("string"), "kind")), fdr)
    return g.select("user_id", "kind", "name", "series", "mean", "lift", "z", "p", (F.col("keep") & (F.abs("z") >= z_least)).alias("clear"))


def taste_groups(rated: DataFrame, items: DataFrame, series: DataFrame) -> DataFrame:
    """(user_id, series_id, kind, name, score): every attribute of every rated title, for ``group_evidence``."""
    at = rated.join(items, "item_id").join(series.select("item_id", "series_id"), "item_id", "left").withColumn("series_id", F.coalesce("series_id", "item_id"))
    era = F.concat((F.floor(F.col("season_year") / 10) * 10).cast("string"), F.lit("s"))
    length = F.when(F.col("num_episodes") >= 50, "long").when(F.col("num_episodes") >= 14, "medium").otherwise("short")
    kinds = F.concat(F.transform("genres", lambda g: F.struct(F.lit("genre").alias("kind"), g.alias("name"))), F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("studio", F.col("studio")), ("format", F.col("media_type")), ("era", era), ("length", length)))))
    return at.select("user_id", "series_id", F.explode(F.array_distinct(kinds)).alias("g"), "score").select("user_id", "series_id", "g.kind", "g.name", "score")


def user_quantiles(sizes: DataFrame, own: DataFrame, everyone: DataFrame, least: int = 40) -> DataFrame:
    """(user_id, source, q): which error quantiles a user's ranges rest on: the own ones from ``least`` held-out ratings, else everyone's."""
    at = sizes.select("user_id", "n").join(own.select("user_id", F.col("q").alias("own")), "user_id", "left").crossJoin(F.broadcast(everyone.select(F.col("q").alias("all"))))  # one row
    mine = (F.col("n") >= least) & F.col("own").isNotNull()
    return at.select("user_id", F.when(mine, "own").otherwise("size").alias("source"), F.when(mine, F.col("own")).otherwise(F.col("all")).alias("q"))


def compared_orders(rows: DataFrame, names: tuple[str, ...], truth: str = "truth") -> DataFrame:
    """(user_id, name, rho): how well each of several predictions (columns) orders a user's ratings."""
    each = rows.select("user_id", F.col(truth).alias("truth"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("prediction")) for n in names))).alias("p"))
    each = each.select(F.struct("user_id", "p.name").alias("key"), "truth", "p.prediction")
    return spearman(each, key="key").select("key.user_id", "key.name", "rho", "n")


def age_shares(lists: DataFrame, items: DataFrame, franchise: DataFrame, year: int) -> DataFrame:
    """(user_id, fresh, old, repeats): shares of titles under two and from ten years of age, and titles beyond the first of a franchise."""
    at = lists.join(items.select("item_id", (F.lit(year) - F.col("season_year")).alias("age")), "item_id").join(franchise.select("item_id", "franchise_id"), "item_id")
    share = lambda c: F.avg(c.cast("double"))
    return at.groupBy("user_id").agg(share(F.col("age") < 2).alias("fresh"), share(F.col("age") >= 10).alias("old"), (F.count("*") - F.count_distinct("franchise_id")).alias("repeats"))


def grid_errors(tried: dict[float, DataFrame]) -> DataFrame:
    """(setting, rmse, bias, n) of each setting's pairs (user_id, prediction, truth), in one job."""
    every = None
    for setting, pairs in tried.items():
        rows = pairs.select(F.lit(setting).alias("setting"), "prediction", "truth")
        every = rows if every is None else every.unionByName(rows)
    return error(every, "setting")
