"""URL verdicts: longest-match rules, and gradient-boosted trees over lexical features for what no rule covers.

The trees learn from the URLs that the rules decide (or from any labelled column). Everything is DataFrame or SQL: the features are
built-in expressions, suffix statistics are a small aggregate joined back by key, and the trees are MLlib's, which run in the JVM.
A labelled url's own host does not count in the statistics that it is taught with, so that these do not give its label away.

Odd cases: null urls and urls without ``://`` have empty host and path and take the model's verdict over their lexical features
(length zero); without any labelled url, or with one kind only, the model answers with the one kind there is (allow, if none);
repeated rows get equal verdicts; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

#: The contract's rules: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: So many labelled urls at most train the trees, half of either kind, picked evenly by a hash; weights give back the true shares.
MAX_TRAIN = 20_000
#: Parts that hosts are dealt into: the statistics of a taught url come from the other parts. Buckets that suffixes are hashed into, so
#: that their tables are bounded, and labelled urls that the overall share counts as in each.
PARTS, SUFFIXES, PRIOR = 4, 1_024, 10.0
TREES, DEPTH = 20, 4
FEATURES = ("url_len", "host_len", "path_len", "depth", "host_labels", "digits", "hyphens", "params", "fragment", "entropy", "secure", "tld_rate", "ending_rate", "section_rate")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, host: str = "host", path: str = "path") -> DataFrame:
    """Add rule (its text, or null) and ruled (its verdict, or null): the longest fitting rule, conditions tried in that order."""
    h, p = F.col(host), F.col(path)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & p.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return df.withColumns({"rule": name, "ruled": verdict})


def _entropy(text: Column) -> Column:
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-12))))))


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("double")


def lexical_features(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Add the lexical features, without the statistics of suffixes."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    return df.withColumns(
        {
            "url_len": F.char_length(u).cast("double"), "host_len": F.char_length(h).cast("double"), "path_len": F.char_length(p).cast("double"), "depth": _count(p, "/"), "host_labels": _count(h, "."),
            "digits": F.coalesce(F.try_divide(_count(u, "0123456789"), F.char_length(u)), F.lit(0.0)), "hyphens": _count(u, "-_"), "params": _count(u, "&") + u.contains("?").cast("double"),
            "fragment": u.contains("#").cast("double"), "entropy": _entropy(u), "secure": u.startswith("https").cast("double"),
            "tld": F.regexp_extract(h, r"([^.:]*)(?::\d*)?$", 1), "ending": F.regexp_extract(p, r"\.([A-Za-z0-9]{1,5})$", 1), "section": F.regexp_extract(p, r"^/([^/]*)", 1),
        }
    )


def _with_rates(rows: DataFrame, prior: float) -> DataFrame:
    """Add the smoothed shares of blocked urls of each suffix; for ruled urls, among hosts of the other parts."""
    for kind in ("tld", "ending", "section"):
        suffix = F.pmod(F.xxhash64(kind), F.lit(SUFFIXES)).alias("suffix")
        seen = rows.filter("ruled is not null").groupBy(suffix).agg(*(F.count_if((F.col("part") == k) & (F.col("ruled") == "block")).alias(f"b{k}") for k in range(PARTS)), *(F.count_if(F.col("part") == k).alias(f"n{k}") for k in range(PARTS)))
        blocked, total = (sum((F.col(f"{x}{k}") for k in range(1, PARTS)), F.col(f"{x}0")) for x in "bn")
        rate = lambda b, n: (b + PRIOR * prior) / (n + PRIOR)
        each = F.array(*(rate(blocked - F.col(f"b{k}"), total - F.col(f"n{k}")) for k in range(PARTS)), rate(blocked, total))
        found = seen.select("suffix", each.alias("rates"))
        place = F.when(F.col("ruled").isNotNull(), F.col("part")).otherwise(F.lit(PARTS))
        rows = rows.withColumn("suffix", F.pmod(F.xxhash64(kind), F.lit(SUFFIXES))).join(F.broadcast(found), "suffix", "left")  # SUFFIXES rows at most
        rows = rows.withColumn(f"{kind}_rate", F.coalesce(F.get("rates", place), F.lit(prior))).drop("suffix", "rates")
    return rows


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, host, path, rule, verdict, block_score) for each row."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = staged(lexical_features(with_rule(base, rules)).withColumn("part", F.pmod(F.xxhash64("host"), F.lit(PARTS)).cast("int")))
    n, blocked = rows.agg(F.count("ruled"), F.count_if(F.col("ruled") == "block")).first()
    if not blocked or blocked == n:
        known = F.lit("block" if blocked else "allow")
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", known).alias("verdict"), F.lit(1.0 if blocked else 0.0).alias("block_score"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_rates(rows, blocked / n))
    half = max(1, max_train // 2)
    picked = None
    for kind, size in (("block", blocked), ("allow", n - blocked)):
        some = rows.filter(F.col("ruled") == kind).select("features", F.lit(float(kind == "block")).alias("label"), F.xxhash64("url", "id").alias("key"), F.lit(size / min(size, half)).alias("weight"))
        some = some.orderBy("key").limit(half)  # some fifteen numbers a row
        picked = some if picked is None else picked.unionByName(some)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=5, weightCol="weight").fit(staged(picked.select("features", "label", "weight")))
    scored = model.transform(rows).withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
