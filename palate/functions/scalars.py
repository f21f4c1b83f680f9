"""Scalar expressions: formats, recency, popularity by age, text and vector similarity, dates, arrays and maps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR_SECONDS = 31_557_600
# Formats that are a supplement to another work, and formats that are never recommended.
SIDE_FORMATS = ("ova", "special", "tv_special")
NOISE_FORMATS = ("music", "cm", "pv")
# Months since the start, share of the eventual audience that a title of this age has; and the least share counted.
GROWTH = ((0, 0), (1, 0.101), (2, 0.125), (3, 0.347), (4, 0.403), (6, 0.462), (9, 0.521), (12, 0.563), (18, 0.624), (24, 0.672), (36, 0.747), (48, 0.805), (60, 0.855), (72, 0.894), (96, 0.958), (121, 1.0))
SHARE_FLOOR, DAYS_A_MONTH = 0.2, 30.44
#: Years from which an age bucket starts; the first starts at 0.
AGE_EDGES = (2, 5, 10, 20)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_class(media_type: Column | str) -> Column:
    """main, side or noise; an unknown or null format is main."""
    m = F.lower(F.coalesce(col(media_type), F.lit("")))
    return F.when(m.isin(*SIDE_FORMATS), "side").when(m.isin(*NOISE_FORMATS), "noise").otherwise("main")


def age_years(at: Column | str, as_of: datetime | Column) -> Column:
    """Years from a timestamp to ``as_of``, not below 0."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return F.greatest((F.unix_micros(now) - F.unix_micros(col(at).cast("timestamp"))) / F.lit(1e6 * YEAR_SECONDS), F.lit(0.0))


def recency_weight(age: Column | str, half_life: float | None = 0.5, floor: float = 0.05) -> Column:
    """floor + (1 - floor) * 0.5^(age / half-life). No half-life, one of 0 or less, or an infinite one: 1."""
    if half_life is None or half_life <= 0 or math.isinf(half_life):
        return F.lit(1.0)
    return F.lit(floor) + F.lit(1 - floor) * F.pow(F.lit(0.5), col(age) / F.lit(float(half_life)))


def season_of(date: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, ("winter", "spring", "summer", "fall"))), F.quarter(col(date)))


def whole_date(text: Column | str) -> Column:
    """Partial dates widen to their first day (2013, 2013-04); impossible ones give null."""
    t = F.trim(col(text))
    return F.try_to_date(F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01"))).when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t))


def novelty(popularity: Column | str) -> Column:
    """0 for the best known title to 1 for one past a popularity rank of about 5,000; null or 0 counts as 9999."""
    rank = F.coalesce(F.nullif(col(popularity), F.lit(0)), F.lit(9999))
    return F.least(F.lit(1.0), F.log10(F.greatest(rank, F.lit(1)).cast("double")) / F.lit(3.7))


def interpolate(x: Column | str, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation, flat outside the knots."""
    x = col(x).cast("double")
    out = F.lit(float(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = F.when(x > float(x0), F.lit(float(y0)) + (F.least(x, F.lit(float(x1))) - float(x0)) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def grown_members(members: Column | str, start: Column | str, today: Column) -> Column:
    """The audience that a title of its age is on course for; without a start date the audience as counted."""
    m = F.coalesce(col(members).cast("double"), F.lit(0.0))
    months = F.greatest(F.datediff(today, col(start)) / F.lit(DAYS_A_MONTH), F.lit(0.0))
    share = F.greatest(F.lit(SHARE_FLOOR), F.least(F.lit(1.0), interpolate(months, GROWTH)))
    return F.when(col(start).isNull(), m).otherwise(m / share)


def age_bucket(years: Column | str) -> Column:
    """0 to 4: under 2, 5, 10, 20 years, and older. Negative ages count as 0, null stays null."""
    y, out = F.greatest(col(years).cast("double"), F.lit(0.0)), F.lit(len(AGE_EDGES))
    for k in range(len(AGE_EDGES) - 1, -1, -1):
        out = F.when(y < AGE_EDGES[k], F.lit(k)).otherwise(out)
    return F.when(col(years).isNotNull(), out)


def size_share(n: Column | str, middle: float, scale: float | None = None) -> Column:
    """Logistic in the list's size: a half at ``middle``."""
    return 1 / (1 + F.exp(-(col(n) - F.lit(float(middle))) / F.lit(float(scale or middle / 3))))


def unit_hash(*parts: Column | str) -> Column:
    """A stable number in [0, 1) for a key."""
    text = F.concat_ws("|", *(col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def words(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column | str) -> Column:
    """The distinct trigrams of each word, padded by two blanks before and one behind."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams over all trigrams; texts without a word: 0."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def matches_all(tokens: Column | str, query: Sequence[str]) -> Column:
    """Full-text AND: every query word is among the tokens."""
    out = F.lit(True)
    for q in query:
        out = out & F.array_contains(col(tokens), q.lower())
    return out


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's, as an aggregate; null where a side is constant."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def l2_normalize(v: Column | str) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = norm(v)
    return F.transform(col(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def merged_maps(old: Column | str, new: Column | str) -> Column:
    """Preferences merged, the new ones winning."""
    old, new = col(old), col(new)
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def drop_column(rate: Column | str) -> Column:
    """A drop rate as a feature: its logarithm, centred and scaled by fixed values; 0 where unknown."""
    return F.coalesce((F.log10(col(rate) + 0.01) + 1.27) / 0.4, F.lit(0.0))


def polar_column(sd: Column | str) -> Column:
    """The spread of a title's scores as a feature, centred and scaled by fixed values; 0 where unknown."""
    return F.coalesce((col(sd) - 1.78) / 0.3, F.lit(0.0))


def spread_of_counts(dist: Column | str, least: int = 50) -> Column:
    """Population standard deviation of a map value -> count; null under ``least`` in all."""
    e = F.map_entries(col(dist))
    total = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda s, x: s + x)
    value = lambda x: x["key"].cast("double")
    n, s1, s2 = (total(lambda x: x["value"].cast("double")), total(lambda x: value(x) * x["value"]), total(lambda x: value(x) * value(x) * x["value"]))
    return F.when(n >= least, F.sqrt(F.greatest(s2 / n - F.pow(s1 / n, F.lit(2)), F.lit(0.0))))


def drop_rate(dropped: Column | str, started: Column | str, least: int = 50) -> Column:
    """Share of starters that dropped; null under ``least`` starters."""
    return F.when(col(started) >= least, col(dropped).cast("double") / col(started))


def error_kind(message: Column | str) -> Column:
    """What a failed job may say in public."""
    m = F.lower(F.coalesce(col(message), F.lit("")))
    return F.when(m.rlike("timeout|timed out|connection|unreachable|50[0-9]"), "source unavailable").when(m.rlike("429|rate"), "source busy").when(m.rlike("40[134]|private|forbidden|not found"), "list not readable").otherwise("internal error")


def length_class(episodes: Column | str) -> Column:
    """How long a title is, by its episodes; an unknown count is short."""
    e = F.coalesce(col(episodes), F.lit(0))
    return F.when(e <= 13, "1-13").when(e <= 26, "14-26").when(e <= 60, "27-60").otherwise("60+")


# Roles whose people become tokens.
STAFF_TOKENS = {"Director": "dir", "Series Composition": "wri", "Script": "wri", "Original Creator": "orig", "Music": "mus"}


def tokens_of(row: DataFrame) -> Column:
    """Category tokens of an item row: genres, studio, format and five-year span; source, rating, length and staff where the row has them
    (staff: array of (role, name))."""
    one = lambda prefix, c, default="": F.array(F.concat(F.lit(prefix), F.coalesce(c, F.lit(default))))
    parts = [F.transform(F.coalesce(row["genres"], F.array().cast("array<string>")), lambda g: F.concat(F.lit("g:"), g)), one("st:", row["studio"]), one("mt:", row["media_type"])]
    parts.append(F.when(row["season_year"].isNotNull(), one("dec:", (F.floor(row["season_year"] / 5) * 5).cast("string"))).otherwise(F.array().cast("array<string>")))
    if "num_episodes" in row.columns:
        parts.append(one("len:", length_class(row["num_episodes"])))
    for prefix, c in (("src:", "source"), ("rt:", "rating")):
        if c in row.columns:
            parts.append(one(prefix, row[c], "None"))
    if "staff" in row.columns:
        known = F.create_map(*(F.lit(x) for pair in STAFF_TOKENS.items() for x in pair))
        named = F.filter(F.coalesce(row["staff"], F.array().cast(row.schema["staff"].dataType)), lambda x: F.array_contains(F.map_keys(known), x["role"]) & x["name"].isNotNull())
        parts.append(F.transform(named, lambda x: F.concat(F.element_at(known, x["role"]), F.lit(":"), x["name"])))
    return F.concat(*parts)


def feature_label(feature: Column | str) -> Column:
    """A feature in words, for explanations: what kind of thing it is and which."""
    f = col(feature)
    kinds = F.create_map(*(F.lit(x) for pair in (("g", "genre"), ("st", "studio"), ("mt", "format"), ("dec", "years"), ("len", "length"), ("src", "source"), ("rt", "rating"), ("dir", "director"), ("wri", "writer"), ("orig", "creator"), ("mus", "music"), ("t", "tag"), ("n", "everyone")) for x in pair))
    return F.concat(F.coalesce(F.try_element_at(kinds, F.split(f, ":")[0]), F.lit("other")), F.lit(" "), F.regexp_replace(f, "^[^:]*:", ""))


def theme_category(category: Column | str, prefixes: Sequence[str] = ("Theme", "Cast", "Setting")) -> Column:
    """Whether a tag's category is one of themes, casts and settings."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.coalesce(col(category).startswith(p), F.lit(False))
    return found


def in_range(value: Column | str, low: int, high: int) -> Column:
    """A saved number if it lies in its range, else nothing."""
    return F.when(col(value).between(low, high), col(value))


def register_functions(spark: SparkSession) -> None:
    """SQL forms; Catalyst inlines their bodies."""
    side, noise = (", ".join(f"'{x}'" for x in xs) for xs in (SIDE_FORMATS, NOISE_FORMATS))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION format_class(m STRING) RETURNS STRING RETURN CASE WHEN lower(coalesce(m, '')) IN ({side}) THEN 'side' WHEN lower(coalesce(m, '')) IN ({noise}) THEN 'noise' ELSE 'main' END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rating_age_years(rated TIMESTAMP, as_of TIMESTAMP) RETURNS DOUBLE RETURN greatest((unix_micros(as_of) - unix_micros(rated)) / 1e6D / {YEAR_SECONDS}, 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION recency_weight(age DOUBLE, half_life DOUBLE, floor DOUBLE) RETURNS DOUBLE RETURN CASE WHEN half_life IS NULL OR half_life <= 0 THEN 1D ELSE floor + (1D - floor) * pow(0.5D, age / half_life) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION novelty(popularity INT) RETURNS DOUBLE RETURN least(1D, log10(greatest(coalesce(nullif(popularity, 0), 9999), 1)) / 3.7D)")
