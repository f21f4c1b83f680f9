"""Per-user models: ridge over sparse item features, the blend with the population, relevance, the order key and its risk terms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..settings import Settings

ALPHAS = (10.0, 30.0, 100.0, 300.0, 1000.0)


#: Numeric columns of a title's features that stand for what everyone thinks of it.
CONSENSUS = ("n:mean", "n:audience", "n:scorers")


def catalogue_features(items: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(item_id, feature, value) of every title: one-hot tokens, tags by rank / 100, and the consensus numbers, centred.

    items: item_id, genres, studio, media_type, season_year, num_episodes, mean, popularity, scorers; tags: (item_id, tag, rank).
    """
    log = lambda c, default, least: F.log10(F.greatest(F.coalesce(F.nullif(c, F.lit(0)), F.lit(default)), F.lit(1)).cast("double")) - least
    numbers = {"n:mean": F.coalesce(F.nullif("mean", F.lit(0.0)), F.lit(7.5)) - 7.5, "n:audience": log("popularity", 5000, 3), "n:scorers": log("scorers", 1000, 4)}
    pairs = F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in numbers.items()))
    out = feature_values(items).unionByName(items.select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.feature", "p.value"))
    return out if tags is None else out.unionByName(tags.groupBy("item_id", F.concat(F.lit("t:"), F.col("tag")).alias("feature")).agg((F.max("rank") / 100).alias("value")))


def user_features(pairs: DataFrame, affinity: DataFrame, franchise: DataFrame, cosine: DataFrame) -> DataFrame:
    """(user_id, item_id, aff, franchise_best, franchise_known, tag_cosine): what a title says to a user, 0 or false where nothing is known."""
    keys = ["user_id", "item_id"]
    out = pairs.select(*keys).join(affinity.select(*keys, F.col("affinity").alias("aff")), keys, "left")
    out = out.join(franchise.select(*keys, F.col("best_delta").alias("franchise_best"), F.col("has_history").alias("franchise_known")), keys, "left")
    out = out.join(cosine.select(*keys, F.col("cosine").alias("tag_cosine")), keys, "left")
    return out.fillna({"aff": 0.0, "franchise_best": 0.0, "tag_cosine": 0.0, "franchise_known": False})


def user_rows(pairs: DataFrame, items: DataFrame, cosine: DataFrame | None = None, staff: DataFrame | None = None) -> DataFrame:
    """The catalogue's rows of the asked (user_id, item_id), with what they say to the user: tag_cosine and staff_aff, 0 where unknown or
    not asked for. Titles that the catalogue lacks have no row."""
    keys = ["user_id", "item_id"]
    out = pairs.select(*keys).distinct().join(items, "item_id")
    for df, source, name in ((cosine, "cosine", "tag_cosine"), (staff, "signal", "staff_aff")):
        out = out.withColumn(name, F.lit(0.0)) if df is None else out.join(df.select(*keys, F.col(source).alias(name)), keys, "left").fillna({name: 0.0})
    return out


def extra_columns(s: Settings) -> tuple[str, ...]:
    """Names of the optional feature columns that the settings switch on."""
    return (("drop_c", "polar_c") if s.content_audience else ()) + (("staff_aff",) if s.content_staff else ()) + (("age_y",) if s.level_trend else ())


def audience_extras(items: DataFrame, s: Settings) -> DataFrame:
    """(item_id, feature, value) of the optional columns of a title: how often it is dropped, as a logarithm, and how divided its
    audience is; 0 where unknown. items: item_id, drop_rate, score_sd. Empty where the settings leave them out."""
    known = {"drop_c": S.drop_column("drop_rate"), "polar_c": S.polar_column("score_sd")}
    on = [n for n in extra_columns(s) if n in known]
    if not on:
        return items.select("item_id", F.lit("").alias("feature"), F.lit(0.0).alias("value")).limit(0)
    pairs = F.array(*(F.struct(F.lit("x:" + n).alias("feature"), known[n].alias("value")) for n in on))
    return items.select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.feature", "p.value")


#: Lists that can have a learned order, and the setting that gives its weight.
LEARNED_ORDER = {"safe_bets": "order_ranker_weight", "discover": "discover_ranker_weight", "hidden_gems": "gems_ranker_weight"}


def enabled_surfaces(s: Settings) -> tuple[str, ...]:
    """The lists whose learned order is switched on."""
    return tuple(n for n, weight in LEARNED_ORDER.items() if getattr(s, weight) > 0)


def surface_key(surface: str, s: Settings) -> dict[str, float]:
    """How the key of a list is formed, for ``order_key``: only safe bets lean on what is well known, and may take another part of the risk."""
    safe = surface == "safe_bets"
    return {"popularity_prior": s.popularity_prior if safe else 0.0, "risk_scale": s.safe_bets_risk if safe else 1.0}


def acclaim_lift(pairs: DataFrame, models: DataFrame, features: DataFrame, rated: DataFrame) -> DataFrame:
    """(user_id, item_id, acclaim): the part of a personal prediction above the user's average rated title that comes from consensus."""
    said = models.filter(F.col("feature").isin(*CONSENSUS))
    part = lambda rows: rows.select("user_id", "item_id").join(features, "item_id").join(said, ["user_id", "feature"]).groupBy("user_id", "item_id").agg(F.sum(F.col("value") * F.col("coef")).alias("x"))
    usual = part(rated).groupBy("user_id").agg(F.avg("x").alias("usual"))
    return part(pairs).join(usual, "user_id").select("user_id", "item_id", (F.col("x") - F.col("usual")).alias("acclaim"))


def disagreement(rows: DataFrame, reference: DataFrame, scale: str = "z") -> DataFrame:
    """Add gap: how much more the population expects than the personal model, in the population's points.

    ``raw``: the difference; ``z``: of standard scores over reference titles (user_id, stack, personal); ``resid``: against what the
    personal model says on average at that score. Users with fewer than 20 reference titles, or without spread, have no gap.
    """
    if scale == "raw":
        return rows.withColumn("gap", F.col("stack") - F.col("personal"))
    both = reference.filter("stack is not null and personal is not null").groupBy("user_id").agg(
        F.count("*").alias("n"), F.avg("stack").alias("ms"), F.stddev_pop("stack").alias("ss"), F.avg("personal").alias("mp"), F.stddev_pop("personal").alias("sp"), S.correlation("stack", "personal").alias("rho")
    ).filter("n >= 20 and ss > 1e-6 and sp > 1e-6")
    zs, zp = (F.col("stack") - F.col("ms")) / F.col("ss"), (F.col("personal") - F.col("mp")) / F.col("sp")
    gap = ((F.col("rho") * zs if scale == "resid" else zs) - zp) * F.col("ss")
    return rows.join(both, "user_id", "left").withColumn("gap", F.coalesce(gap, F.lit(0.0))).drop("n", "ms", "ss", "mp", "sp", "rho")


def reference_titles(items: DataFrame, rated: DataFrame, most: int = 500, head: int = 8) -> DataFrame:
    """(user_id, item_id): of each user the ``most`` titles of a main format with the most scorers that they have not rated.

    The head of the catalogue (``head`` times as many) goes to every user as one array and loses what the user has rated, so users and
    titles are not multiplied. items: item_id, media_type, scorers.
    """
    main = items.filter(S.format_class("media_type") == "main").orderBy(F.desc_nulls_last("scorers"), "item_id").limit(head * most)
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("scorers", F.lit(0))).alias("s"), "item_id"))), lambda x: x["item_id"])
    row = main.agg(best.alias("best"))  # one row of head * most ids
    own = rated.groupBy("user_id").agg(F.collect_set("item_id").alias("own"))  # one user's list
    left = own.crossJoin(F.broadcast(row)).select("user_id", F.slice(F.array_except("best", "own"), 1, most).alias("left"))
    return left.select("user_id", F.explode("left").alias("item_id"))


def blend_search(rows: DataFrame, least: int = 20, steps: int = 10) -> DataFrame:
    """(user_id, share): of 0, 0.1, ..., 1 the personal share with the least squared error on held-out ratings; ties to the smaller one.

    rows: (user_id, stack, personal, truth), held out of both fits. A user's error is a parabola in the share, so five sums tell all.
    """
    d, e = F.col("personal") - F.col("stack"), F.col("truth") - F.col("stack")
    sums = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(d * d).alias("dd"), F.sum(d * e).alias("de")).filter(F.col("n") >= least)
    loss = lambda k: k * k * F.col("dd") - 2 * k * F.col("de")
    best = F.array_min(F.array(*(F.struct(F.round(loss(k / steps), 9).alias("loss"), F.lit(k / steps).alias("share")) for k in range(steps + 1))))
    return sums.select("user_id", best["share"].alias("share"))


def choose_setting(scores: DataFrame, default: float, margin: float = 0.002, least: int = 100) -> DataFrame:
    """(user_id, value): of several settings (user_id, value, rho, n) the one that orders a user's held-out ratings best, if it beats the
    default by more than ``margin`` and the user has ``least`` ratings; else the default."""
    at = scores.groupBy("user_id").agg(F.max(F.when(F.col("value") == default, F.col("rho"))).alias("base"), F.max(F.struct("rho", (-F.col("value")).alias("v"))).alias("best"), F.max("n").alias("n"))
    better = (F.col("n") >= least) & (F.coalesce(F.col("best.rho") > F.coalesce("base", F.lit(-1.0)) + margin, F.lit(False)))
    return at.select("user_id", F.when(better, -F.col("best.v")).otherwise(F.lit(default)).alias("value"))


def level_trend(examples: DataFrame, kind: str = "lin3") -> DataFrame:
    """Add age_y, how long before a user's newest rating each one was given: years up to 3 (``lin3``), the log of one more (``log``), or
    (``power``) the signed power 0.4 of the days from the user's mean rating date, in tenths, less what it is today. Undated ratings
    have 0. Examples carry it and predictions do not (0), so these are made at today's level."""
    user = Window.partitionBy("user_id")
    newest = F.max("rated_at").over(user)
    if kind == "power":
        at = F.unix_micros(F.col("rated_at").cast("timestamp")) / F.lit(1e6 * 86_400)
        curve = lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(0.4)) / 10
        middle = F.avg(at).over(user)
        return examples.withColumn("age_y", F.coalesce(curve(at - middle) - curve(F.max(at).over(user) - middle), F.lit(0.0)))
    if kind not in ("lin3", "log"):
        raise ValueError("kind is lin3, log or power")
    years = (F.unix_micros(newest.cast("timestamp")) - F.unix_micros(F.col("rated_at").cast("timestamp"))) / F.lit(1e6 * S.YEAR_SECONDS)
    age = F.least(years, F.lit(3.0)) if kind == "lin3" else F.log1p(F.greatest(years, F.lit(0.0)))
    return examples.withColumn("age_y", F.when(years.isNotNull(), age).otherwise(F.lit(0.0)))


def serving_mode(n: Column | str, blend_from: int = 300) -> Column:
    """Long histories are blended by their own measure, others by the size of the list."""
    return F.when(S.col(n) >= blend_from, "blend").otherwise("sized")


def ranking_rows(terms: DataFrame, facts: DataFrame, taste: DataFrame, profile: DataFrame, this_year: int) -> DataFrame:
    """(user_id, item_id, and the inputs of a learned order): the key's terms, both predictions, facts of the title and the user's taste.

    terms: of ``order_key``; facts: item_id, mean, scorers, popularity, season_year, num_episodes, genres; taste: user_id, long_share,
    long_lift, long_drop; profile: (user_id, genre, share).
    """
    fit = terms.select("user_id", "item_id").join(facts.select("item_id", "genres", F.explode("genres").alias("genre")), "item_id").join(profile, ["user_id", "genre"])
    fit = fit.groupBy("user_id", "item_id").agg((F.sum("share") / F.greatest(F.size(F.first("genres")), F.lit(1))).alias("genre_fit"))
    own = ("shown", "z", "prior", "risk_long", "risk_disagree", "risk_unfamiliar", "risk_acclaim", "share")
    out = terms.select("user_id", "item_id", *own, F.col("stack").alias("pred_pop"), F.coalesce("personal", "stack").alias("pred_personal"), (F.coalesce("personal", "stack") - F.col("stack")).alias("pred_gap"), F.log1p("n").alias("log_n"))
    out = out.join(facts.select("item_id", F.coalesce("mean", F.lit(7.0)).alias("mean"), F.log1p(F.coalesce("scorers", F.lit(0))).alias("log_scorers"), F.log10(F.greatest(F.coalesce("popularity", F.lit(99999)), F.lit(1)).cast("double")).alias("log_rank"), (this_year - F.col("season_year")).cast("double").alias("age"), F.coalesce("num_episodes", F.lit(0)).cast("double").alias("episodes"), S.novelty("popularity").alias("novelty")), "item_id")
    return out.join(fit, ["user_id", "item_id"], "left").join(taste, "user_id", "left").fillna(0.0)


RANKING_INPUTS = ("shown", "z", "prior", "risk_long", "risk_disagree", "risk_unfamiliar", "risk_acclaim", "share", "pred_pop", "pred_personal", "pred_gap", "log_n", "mean", "log_scorers", "log_rank", "age", "episodes", "novelty", "genre_fit", "long_share", "long_lift", "long_drop")


def fit_boosted(rows: DataFrame, inputs: tuple[str, ...] = RANKING_INPUTS, label: str = "gain", trees: int = 30, depth: int = 4):
    """Boosted trees on the gains, in the JVM. MLlib has no ranking loss, so the order is learned from the gains themselves; the numbers
    are not comparable with those of a ranker trained on pairs or lists."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    steps = [VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=3, predictionCol="learned")]
    return Pipeline(stages=steps).fit(rows.select(*inputs, F.col(label).cast("double").alias(label)))


def feature_values(items: DataFrame, numeric: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, feature, value): one-hot tokens of each title, and numeric columns as they are."""
    tokens = items.select("item_id", F.explode(S.tokens_of(items)).alias("feature")).distinct().withColumn("value", F.lit(1.0))
    if not numeric:
        return tokens
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric))
    return tokens.unionByName(items.select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.feature", "p.value").filter("value is not null"))


def vocabulary(examples: DataFrame, features: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, feature): features of at least ``least`` of a user's titles."""
    return examples.select("user_id", "item_id").join(features.select("item_id", "feature"), "item_id").groupBy("user_id", "feature").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("user_id", "feature")


def choose_alpha(x: np.ndarray, y: np.ndarray, w: np.ndarray, alphas=ALPHAS, folds: int = 10) -> float:
    """The penalty with the least weighted cross-validation error, for a dense matrix."""
    from .training import Design, best_alpha

    return best_alpha(Design([None] * len(x), [None] * len(x), extra=x), y, w, alphas, folds)


def ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    from .training import Design

    return Design([None] * len(x), [None] * len(x), extra=x).sums(np.arange(len(x)), y, w).solutions((alpha,))[0]


def fit_users(examples: DataFrame, features: DataFrame, vocab: DataFrame | None = None, alphas=ALPHAS) -> DataFrame:
    """(user_id, feature, coef) with an 'intercept' row and the chosen penalty as 'alpha'. A solve reads one user's examples.

    examples: (user_id, item_id, score, w). Titles come with their features packed, so one row an example is shuffled; a user's
    vocabulary (features of three titles or more) is counted in the group, unless ``vocab`` (user_id, feature) gives it.
    """
    from .training import Design, best_alpha, packed_features

    rows = examples.select("user_id", "item_id", F.col("score").cast("double").alias("y"), "w").join(packed_features(features), "item_id", "left")
    if vocab is not None:
        rows = rows.join(vocab.groupBy("user_id").agg(F.array_sort(F.collect_set("feature")).alias("names")), "user_id", "left")  # one user's features

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        one = group.drop_duplicates("item_id").sort_values("item_id")
        given = None if "names" not in one else [] if one["names"].iloc[0] is None else list(one["names"].iloc[0])
        design = Design(one["f"].tolist(), one["v"].tolist(), names=given)
        y, w = one["y"].to_numpy(), one["w"].to_numpy()
        if not design.names or w.sum() <= 0:
            coef, intercept, alpha = np.zeros(design.width), float(y.mean()), 0.0
        else:
            alpha = best_alpha(design, y, w, alphas)
            (coef, intercept), *_ = design.sums(np.arange(design.n), y, w).solutions((alpha,))
        return pd.DataFrame({"user_id": group["user_id"].iloc[0], "feature": [*design.names, "intercept", "alpha"], "coef": [*coef, intercept, alpha]})

    return rows.groupBy("user_id").applyInPandas(fit, "user_id long, feature string, coef double")


def predict_personal(pairs: DataFrame, models: DataFrame, features: DataFrame) -> DataFrame:
    """(user_id, item_id, personal)"""
    keys = ["user_id", "item_id"]
    base = models.filter("feature = 'intercept'").select("user_id", F.col("coef").alias("base"))
    parts = pairs.select(*keys).join(features, "item_id").join(models, ["user_id", "feature"]).groupBy(*keys).agg(F.sum(F.col("value") * F.col("coef")).alias("x"))
    return pairs.select(*keys).join(base, "user_id").join(parts, keys, "left").select(*keys, (F.col("base") + F.coalesce("x", F.lit(0.0))).alias("personal"))


def contributions(pairs: DataFrame, models: DataFrame, features: DataFrame, top: int = 5) -> DataFrame:
    """(user_id, item_id, feature, part, rank): what raises or lowers a prediction against the user's average candidate."""
    parts = pairs.select("user_id", "item_id").join(features, "item_id").join(models, ["user_id", "feature"]).select("user_id", "item_id", "feature", (F.col("value") * F.col("coef")).alias("x"))
    n = pairs.groupBy("user_id").agg(F.count("*").alias("n"))
    mean = parts.groupBy("user_id", "feature").agg(F.sum("x").alias("total")).join(n, "user_id").select("user_id", "feature", (F.col("total") / F.col("n")).alias("mean"))
    parts = parts.join(mean, ["user_id", "feature"]).select("user_id", "item_id", "feature", (F.col("x") - F.col("mean")).alias("part"))
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy(F.desc(F.abs("part")), "feature"))).filter(F.col("rank") <= top)


def feature_importance(models: DataFrame, top: int = 10) -> DataFrame:
    rows = models.filter(~F.col("feature").isin("intercept", "alpha"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.abs("coef")), "feature"))).filter(F.col("rank") <= top)


def blend(rows: DataFrame, n: str = "n", s: Settings | None = None) -> DataFrame:
    """Add share (of the personal model, by list size) and prediction. rows: (personal, stack, n)."""
    s = s or Settings()
    share = F.lit(s.blend_share_max) * S.size_share(n, s.blend_size_middle)
    return rows.withColumn("share", share).withColumn("prediction", F.coalesce(F.col("share") * F.col("personal") + (1 - F.col("share")) * F.col("stack"), "stack", "personal"))


def z_in(value: Column | str, partition: tuple[str, ...] = ("user_id",)) -> Column:
    """Standard score over a user's whole candidate set (population deviation); 0 where all are equal."""
    v, w = S.col(value), Window.partitionBy(*partition)
    sd = F.stddev_pop(v).over(w)
    return F.when(sd > 1e-9, (v - F.avg(v).over(w)) / sd).otherwise(F.lit(0.0))


def relevance(rows: DataFrame) -> DataFrame:
    """Add z: the mean of the standard scores of rel and ease; items without ease take the user's least."""
    least = F.min("ease").over(Window.partitionBy("user_id"))
    filled = rows.withColumn("__ease", F.coalesce("ease", least, F.lit(0.0)))
    return filled.withColumn("z", (z_in("rel") + z_in("__ease")) / 2).drop("__ease")


def relevance_bonus(z: Column | str, share: Column | str, s: Settings) -> Column:
    """Points for relevance: full for population ranking, clipped and weighed apart for the personal share."""
    z, share = S.col(z), S.col(share)
    return s.relevance_weight * (1 - share) * z + s.relevance_weight_personal * share * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z))


def long_running(episodes: Column | str, status: Column | str, year: Column | str, this_year: int) -> Column:
    """50 episodes or more, or airing for three years without a count."""
    e = F.coalesce(S.col(episodes), F.lit(0))
    return (e >= 50) | ((S.col(status) == "currently_airing") & (e == 0) & (F.coalesce(S.col(year), F.lit(this_year)) <= this_year - 3))


def order_key(rows: DataFrame, this_year: int, s: Settings | None = None, popularity_prior: float = 0.0, risk_scale: float = 1.0) -> DataFrame:
    """Add the terms of a tab's order and their sum, key.

    rows: user_id, item_id, prediction, personal, stack, share, z, popularity, num_episodes, status, season_year, unfamiliar (boolean),
    acclaim (points of the personal prediction that come from consensus columns), evidence; gap (of ``disagreement``), if another
    measure than the plain difference is wanted.
    """
    s = s or Settings()
    shown = F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("prediction")))
    out = rows.withColumn("shown", shown).withColumn("relevance", relevance_bonus("z", "share", s)).withColumn("__key", F.col("shown") + F.col("relevance"))
    known = -F.log10(F.greatest(F.coalesce(F.nullif("popularity", F.lit(0)), F.lit(99999)), F.lit(1)).cast("double"))
    out = out.withColumn("__known", known).withColumn("prior", popularity_prior * (1 - F.col("share")) * F.coalesce(F.stddev_pop("__key").over(Window.partitionBy("user_id")), F.lit(0.0)) * z_in("__known"))
    trust = F.least(F.lit(1.0), F.col("share") / F.lit(max(s.blend_share_max, 1e-6)))
    out = out.withColumns(
        {
            "risk_long": s.long_series_penalty * long_running("num_episodes", "status", "season_year", this_year).cast("double"),
            "risk_disagree": trust * s.disagreement_penalty * F.greatest(F.coalesce(F.col("gap") if "gap" in rows.columns else F.col("stack") - F.col("personal"), F.lit(0.0)), F.lit(0.0)),
            "risk_unfamiliar": trust * s.unfamiliar_genre_penalty * F.coalesce("unfamiliar", F.lit(False)).cast("double"),
            "risk_acclaim": trust * s.acclaim_penalty * F.greatest(F.coalesce("acclaim", F.lit(0.0)), F.lit(0.0)) * s.acclaim_evidence / (s.acclaim_evidence + F.coalesce("evidence", F.lit(0.0))),
        }
    )
    out = out.withColumn("risk", risk_scale * (F.col("risk_long") + F.col("risk_disagree") + F.col("risk_unfamiliar") + F.col("risk_acclaim")))
    return out.withColumn("key", F.col("__key") + F.col("prior") - F.col("risk")).drop("__key", "__known")


def learned_shift(rows: DataFrame, weight: float, shortlist: int = 600) -> DataFrame:
    """Add mixed: key and a learned rank score (column learned) mixed as standard scores inside each user's shortlist; the rest stays below."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("key"), "item_id"))
    rows = rows.withColumn("__in", place <= shortlist)
    w = Window.partitionBy("user_id", "__in")
    zed = lambda c: F.when(F.stddev_pop(c).over(w) > 1e-9, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(F.lit(0.0))
    inside = F.avg("key").over(w) + F.stddev_pop("key").over(w) * ((1 - weight) * zed("key") + weight * zed("learned"))
    rows = rows.withColumn("__mixed", F.when(F.col("__in"), inside))
    low = F.min("__mixed").over(Window.partitionBy("user_id"))
    high = F.max(F.when(~F.col("__in"), F.col("key"))).over(Window.partitionBy("user_id"))
    return rows.withColumn("mixed", F.when(F.col("__in"), F.col("__mixed")).otherwise(F.col("key") + F.least(F.lit(0.0), low - high - 1e-6))).drop("__in", "__mixed")


def rank_labels(rows: DataFrame) -> DataFrame:
    """Add label (0 to 2) and gain. rows: score or null, listed, mu, propensity: disliked and unlisted 0, liked lists 1, favourites 2."""
    label = F.when(F.col("score") >= F.greatest(F.col("mu") + 1, F.lit(8.0)), 2).when((F.col("score") >= F.col("mu")) | (F.col("listed") & (F.coalesce("score", F.lit(0)) == 0)), 1).otherwise(0)
    return rows.withColumn("label", label).withColumn("gain", F.when(F.col("label") > 0, F.round(F.col("label") * F.least(F.lit(10.0), 1 / F.greatest(F.col("propensity"), F.lit(0.05)))).cast("int")).otherwise(0))


def fit_pairwise(rows: DataFrame, inputs: list[str], per_query: int = 50, reg: float = 1e-3) -> DataFrame:
    """(feature, coef): a linear ranker by logistic regression on differences of a liked and another title of the same user.

    It stands in for the boosted ranker of the service, for which MLlib has no counterpart; the numbers are not comparable.
    Each liked title meets ``per_query`` others, dealt by hash.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    good = rows.filter("label > 0").select("user_id", F.col("item_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in inputs))
    rest = rows.filter("label = 0").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.xxhash64("item_id"), "item_id"))).filter(F.col("k") <= per_query)
    pairs = good.join(rest.select("user_id", F.col("item_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in inputs)), "user_id")
    sign = F.when(F.xxhash64("a", "b") % 2 == 0, 1.0).otherwise(-1.0)
    diffs = pairs.select(*((sign * (F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(c) for c in inputs), (sign > 0).cast("double").alias("label"))
    model = LogisticRegression(fitIntercept=False, regParam=reg, standardization=True).fit(VectorAssembler(inputCols=inputs, outputCol="features").transform(diffs))
    return rows.sparkSession.createDataFrame([*zip(inputs, map(float, model.coefficients), strict=True)], "feature string, coef double")


def explain_terms(keyed: DataFrame) -> DataFrame:
    """(user_id, item_id, term, points): every term of the order key as a row; risks count against a title."""
    terms = {"shown": F.col("shown"), "relevance": F.col("relevance"), "prior": F.col("prior")} | {r: -F.col(f"risk_{r}") for r in ("long", "disagree", "unfamiliar", "acclaim")}
    rows = F.array(*(F.struct(F.lit(k).alias("term"), v.cast("double").alias("points")) for k, v in terms.items()))
    return keyed.select("user_id", "item_id", F.explode(rows).alias("r")).select("user_id", "item_id", "r.term", "r.points")
