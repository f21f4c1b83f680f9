"""Quality rules: text statistics, fixed base rules, and a learned decision list as an ordered Spark conditional expression.

Statistics are built-in expressions over the whole text. The list is learned by sequential covering: a rule grows by the threshold
condition of highest gain until it covers no good text it could avoid, is pruned on held-out rows, joins the list if it is still
precise there, and the rows that it covers leave the table before the next rule grows. Each step counts all candidate conditions in
one aggregation; only these counts reach the driver.

Odd cases: null and empty texts have no words and zero counts and fail the base rules; without labels, or with one kind, the list is
empty and keeps everything that passes the base rules; equal rows get equal verdicts; texts are read whole; extra columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, checkpointed, words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled rows that teach at most, thresholds a statistic, conditions a rule, rules, least held-out precision of a rule, least rows it must catch.
MAX_TRAIN, CUTS, CONDITIONS, RULES, PRECISION, LEAST = 20_000, 12, 3, 6, 0.95, 5
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "mean_line")


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: it becomes a lambda variable, which the optimizer cannot inline into a loop."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Hashes of windows are sorted; equal neighbours mark their words."""

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(placed, marked))

    def marked(s: Column) -> Column:
        same = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return _bound(F.transform(F.filter(s, same), lambda x: x["i"]), lambda at: F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))))

    return _bound(ws, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_bound(hashes(w), covered)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) and the inputs of the learned rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    step = step.select("id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    step = step.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - _n(F.col("t"), SPACE_CLASS)).alias("word_chars"),
        _n(F.col("t"), SYMBOLS).alias("n_symbols"),
        _bound(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        _n(F.col("t"), "[A-Z]").alias("n_upper"),
        _n(F.col("t"), "[0-9]").alias("n_digits"),
        _n(F.col("t"), "[!?.,;:]").alias("n_marks"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    return step.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "word_chars").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"), share("n_repeat_words", "n_words").alias("repeats"),
        share("n_upper", "word_chars").alias("upper"), share("n_digits", "word_chars").alias("digits"), share("n_marks", "n_words").alias("marks"), share("n_words", "n_lines").alias("mean_line"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.above else F.col(self.feature) < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _fits(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _bad_good(rows: DataFrame) -> tuple[int, int]:
    bad, n = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    return bad, n - bad


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(bad, good) rows under each candidate condition: one aggregation by feature and bin, summed up over the bins here."""
    each = rows.select("bad", F.posexplode("bins").alias("k", "bin")).groupBy("k", "bin").agg(F.sum("bad").alias("b"), F.count("*").alias("n")).collect()  # a row a bin
    out: dict[Condition, tuple[int, int]] = {}
    for k, (feature, points) in enumerate(cuts.items()):
        for i, cut in enumerate(points):
            for above in (True, False):
                here = [r for r in each if r["k"] == k and (r["bin"] > i) == above]
                out[Condition(feature, above, cut)] = (sum(r["b"] for r in here), sum(r["n"] - r["b"] for r in here))
    return out


def _bin(value: Column, points: Sequence[float]) -> Column:
    """How many of the points are at or under the value."""
    return F.size(F.filter(F.array(*map(F.lit, points)), lambda point: point <= value))


def _gain(now: tuple[int, int], then: tuple[int, int]) -> float:
    """Foil's information gain for the bad rows."""
    return now[0] * (math.log2(now[0] / sum(now)) - math.log2(then[0] / sum(then))) if now[0] >= LEAST else 0.0


def learn(stats: DataFrame, features: Sequence[str] = FEATURES, rules: int = RULES, conditions: int = CONDITIONS) -> list[Rule]:
    """A decision list of rules for bad rows from (features, bad int, grown boolean); the rows that are not grown prune."""
    stats = checkpointed(stats.select("bad", "grown", *features))
    if 0 in _bad_good(stats.filter("grown")):
        return []
    points = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    spread = stats.groupBy("bad").agg(*(F.percentile_approx(f, points, 1000).alias(f) for f in features)).collect()
    cuts = {f: sorted({float(x) for r in spread for x in r[f]}) for f in features}
    stats = checkpointed(stats.withColumn("bins", F.array(*(_bin(F.col(f).cast("double"), c) for f, c in cuts.items()))))
    grow, prune = stats.filter("grown"), stats.filter("not grown")
    found: list[Rule] = []
    while len(found) < rules:
        rule: list[Condition] = []
        then = _bad_good(grow)
        while len(rule) < conditions and then[0] >= LEAST and then[1]:
            counts = _counts(grow.filter(_fits(rule)), cuts)
            best = max(counts, key=lambda c: (_gain(counts[c], then), -sum(counts[c])))
            if _gain(counts[best], then) <= 1e-9:
                break
            rule.append(best)
            then = counts[best]
        if not rule:
            break
        held = [_bad_good(prune.filter(_fits(rule[:k]))) for k in range(1, len(rule) + 1)]
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in held]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        kept, (b, g) = tuple(rule[: k + 1]), held[k]
        if not b or b / (b + g) < PRECISION:
            break
        found.append(kept)
        grow, prune = grow.filter(~_fits(kept)), prune.filter(~_fits(kept))
    return found


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one conditional expression: the first rule that fits rejects, else the row stays."""
    out = F
    for rule in rules:
        out = out.when(_fits(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, rules: int = RULES, conditions: int = CONDITIONS) -> DataFrame:
    """(id, statistics, base_failed, kept) of each row; labels: 1 good, 0 bad."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 0).cast("int").alias("bad")).filter("id is not null and bad is not null")
    known = known.groupBy("id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    taught = statistics(docs.join(F.broadcast(known.select(F.col("id").alias(id_col))), id_col, "left_semi"), id_col, text_col).join(F.broadcast(known), "id")  # max_train rows of two numbers
    taught = checkpointed(taught).filter("not base_failed").withColumn("grown", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0)
    out = statistics(docs, id_col, text_col).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(learn(taught, rules=rules, conditions=conditions))))
    return out.withColumnRenamed("id", id_col)
