"""Mixing to target weights with soft membership.

A multinomial classifier, trained on a labelled table, gives each document a posterior over domains. Document rates r >= floor are
then fitted so that the expected tokens of each domain, sum of r * tokens * posterior, match the targets: projected-gradient least
squares, each step one aggregation of sums a domain over a table of (tokens, posterior). Gradients are taken per token, so that
documents of equal posterior get equal rates whatever their length, and scaled by the tokens that each domain has in documents whose
rate is free to move, so that a rare domain is settled as fast as a common one; a step that does not come nearer is halved. Rates
turn into whole copies: the integer part for all, one more for the fraction of documents that a hash of the id picks.

Everything is DataFrame, SQL or MLlib. Only sums a domain reach the driver.

Odd cases: null and empty texts have no tokens, pull no total and keep the rate that their posterior gives; with one domain (or
none) in the labelled table all rates are 1; targets of unknown domains are refused; equal rows get equal rates; extra columns are
kept (posterior, rate, n_words are replaced). Targets that the floor or the posteriors put out of reach are met as nearly as least
squares can; ``fit_rates`` gives the totals reached, and ``mix`` warns where they miss.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged, words

#: Labelled rows that train at most, buckets of hashed words, steps of the descent, and the distance at which it stops: of all tokens, and
#: of each domain's own target.
MAX_TRAIN, BUCKETS, STEPS, CLOSE, CLOSE_EACH = 4_000, 256, 30, 1e-3, 5e-3
#: Multiples of the least growth that are tried where the growth is left open.
GROW = (1.0, 1.15, 1.35, 1.6, 2.0)


def _features(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: hashed words and the shares of capitals, digits and symbols; n_words: the words of the text."""
    w, tf, unit, m0, m1, m2 = fresh([*docs.columns, out], "w", "tf", "unit", "m0", "m1", "m2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = lambda pattern: F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), F.char_length(text)), F.lit(0.0))
    rows = docs.withColumn(w, words(F.lower(text))).withColumns({"n_words": F.size(w).cast("long"), m0: share("[#*$%&|<>!]"), m1: share("[A-Z]"), m2: share("[0-9]")})
    rows = Normalizer(inputCol=tf, outputCol=unit, p=2.0).transform(HashingTF(inputCol=w, outputCol=tf, numFeatures=BUCKETS).transform(rows))
    return VectorAssembler(inputCols=[unit, m0, m1, m2], outputCol=out).transform(rows).drop(w, tf, unit, m0, m1, m2)


def with_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """Add n_words and posterior (an array in the order of ``domains``). labelled: (id, domain), of which ``max_train`` ids at most
    train, picked evenly by a hash; only ids travel to be picked."""
    known = labelled.filter(F.col("domain").isin(domains) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_train).select("id", (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("double").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # max_train rows of two numbers
    train = staged(_features(texts, "text", "x").select("x", "label"))
    if train.select("label").distinct().count() < 2:
        seen = train.select("label").first()
        flat = [1.0 if seen and k == int(seen[0]) else 0.0 for k in range(len(domains))]
        return docs.withColumns({"n_words": F.size(words(F.col(text_col))).cast("long"), "posterior": F.array(*map(F.lit, flat))})
    x, p, raw, pred = fresh([*docs.columns, "n_words", "posterior"], "x", "p", "raw", "pred")
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", maxIter=60, regParam=1e-4, probabilityCol=p, rawPredictionCol=raw, predictionCol=pred).fit(train)
    found, n = vector_to_array(p), model.numClasses
    posterior = F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda k: F.when(k < n, found[k]).otherwise(F.lit(0.0)))
    rows = model.setFeaturesCol(x).transform(_features(docs, text_col, x))
    return rows.withColumn("posterior", posterior).drop(x, p, raw, pred)


def _rate(steps: list[list[float]], floor: float, posterior: str = "posterior") -> Column:
    """The rate after the given steps, from 1: each moves along the posterior and is projected to the floor."""
    if not steps:
        return F.lit(1.0)
    move = lambda s: F.aggregate(F.zip_with(F.col(posterior), s, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.array(*(F.array(*map(F.lit, s)) for s in steps)), F.lit(1.0), lambda r, s: F.greatest(F.lit(floor), r + move(s)))


def fit_rates(rows: DataFrame, targets: list[float], floor: float = 0.0, growth: float | None = 1.0, steps: int = STEPS, most_growth: float = 2.0) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps of projected gradient for ``_rate``, the domain totals they reach, and those wanted. rows: (n_words, posterior); targets sum to 1.

    ``growth``: tokens wanted overall, as a multiple of those there are; None: the least multiple at which no domain has more than is
    wanted of it, up to ``most_growth``.
    """
    k = len(targets)
    table = staged(rows.select(F.col("n_words").cast("double").alias("n_words"), "posterior"))
    cell = lambda i: F.col("posterior")[i]
    upper = np.triu_indices(k)

    def totals(taken: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """What each domain gets, and the tokens of each two domains in documents whose rate may still fall or is above the floor."""
        at = table.withColumn("r", _rate(taken, floor))
        free = F.when(F.col("r") > floor, F.col("n_words")).otherwise(0.0) if taken else F.col("n_words")
        got = at.agg(*(F.sum(F.col("r") * F.col("n_words") * cell(i)) for i in range(k)), *(F.sum(free * cell(i) * cell(j)) for i, j in zip(*(x.tolist() for x in upper), strict=True))).first()
        numbers, both = np.array([x or 0.0 for x in got]), np.zeros((k, k))
        both[upper] = both.T[upper] = numbers[k:]
        return numbers[:k], both

    now, shared = totals([])
    if now.sum() <= 0:
        return [], now.tolist(), now.tolist()
    aim, there = np.array(targets) / sum(targets), now.sum()
    least = float(min(most_growth, max(1.0, np.max(now[aim > 0] / (aim[aim > 0] * there), initial=1.0)))) if growth is None else growth
    taken: list[list[float]] = []
    for more in GROW if growth is None else (1.0,):  # with mixed posteriors, wanting less of none may take more of all
        want = aim * min(most_growth if growth is None else least, least * more) * there
        taken, got = _descend(totals, now, shared, want, steps)
        if _met(got, want):
            break
    return taken, got.tolist(), want.tolist()


def _met(got: np.ndarray, want: np.ndarray) -> bool:
    return bool(np.abs(want - got).sum() <= CLOSE * want.sum() and (np.abs(want - got) <= CLOSE_EACH * np.maximum(want, CLOSE * want.sum())).all())


def _descend(totals, now: np.ndarray, shared: np.ndarray, want: np.ndarray, steps: int) -> tuple[list[list[float]], np.ndarray]:
    """Steps towards the wanted totals; ``totals`` gives what steps reach and the scale of the next one."""
    taken: list[list[float]] = []
    size = 1.0
    for _ in range(steps):
        if _met(now, want):
            break
        scale = shared + 1e-9 * np.trace(shared) * np.eye(len(want))
        step = (size * np.linalg.solve(scale, want - now)).tolist()
        then, after = totals([*taken, step])
        if np.abs(want - then).sum() < np.abs(want - now).sum():
            taken.append(step)
            now, shared, size = then, after, min(1.0, 2 * size)
        else:
            size /= 2
            if size < 1e-2:
                break
    return taken, now


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0, growth: float | None = 1.0, most_growth: float = 2.0) -> DataFrame:
    """Add n_words, posterior, rate and copies (how often the document goes into the mix).

    labelled: (id, domain). floor: the least rate; 1.0 keeps every document at least once and reaches the targets by repetition, with
    ``growth`` times the tokens (None: as many as that takes, ``most_growth`` at most). Totals that miss their targets are warned of.
    """
    domains = sorted(targets)
    if not domains or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets: a nonnegative weight a domain, not all zero")
    rows = staged(with_posteriors(docs.drop("n_words", "posterior", "rate", "copies"), labelled, domains, id_col, text_col))
    taken, got, want = fit_rates(rows, [targets[d] for d in domains], floor, growth, most_growth=most_growth)
    missed = {d: (round(g), round(w)) for d, g, w in zip(domains, got, want, strict=True) if abs(g - w) > 0.02 * max(w, 1.0)}
    if missed:
        warnings.warn(f"tokens reached and wanted: {missed}", stacklevel=2)
    rate = rows.withColumn("rate", _rate(taken, floor))
    drawn = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(17), F.col(id_col))).otherwise(F.xxhash64(F.lit(17), F.col(text_col)))
    luck = F.pmod(drawn, F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rate.withColumn("copies", (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))
