"""Exact removal of lines that several documents share.

Every line is exploded as a 128-bit key with its position; keys are counted with partial aggregation, so a line that a third of
all documents hold reaches the reducers as one row a task. Only the positions to drop travel back, one small array a document, and
the text is cut with array slices in linear time. Texts shuffle once, in the last join.

Odd cases: null text counts as one empty line; keys shorter than ``min_chars`` are never dropped; a line repeated inside the only
document that holds it stays; rows with the same doc_id are one document (each of them is cut, none loses lines to the other);
null doc_ids are documents that own nothing they share with a numbered one. Extra columns are kept unless named as an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, fresh, staged

#: Defaults of the contract: keys of at least ten code points, found in at least two documents.
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes: at 10^12 lines one of 64 bits would join different lines."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Add n_lines, n_dropped and kept_text: each shared line stays in the smallest id that holds it only."""
    out = ("n_lines", "n_dropped", "kept_text")
    base = docs.drop(*(c for c in out if c in docs.columns))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = base.select(F.col(id_col).alias("d"), text.alias("t"))
    lines = slim.select("d", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars).select("d", "th", "pos", *_hashes(F.col("key")))
    shared = lines.groupBy("h1", "h2").agg(F.min("d").alias("owner"), F.max("d").alias("last"), F.count_if(F.col("d").isNull()).alias("nulls"))
    shared = shared.filter((F.col("owner") < F.col("last")) | ((F.col("nulls") > 0) & F.col("owner").isNotNull())).select("h1", "h2", "owner")
    shared = staged(shared)  # so that the join below has an exchange of its own on either side, which Spark splits where a line is hot
    lost = lines.join(shared, ["h1", "h2"]).filter(~F.col("d").eqNullSafe(F.col("owner"))).select("d", "th", "pos")
    lost = lost.groupBy("d", "th").agg(F.array_sort(F.collect_set("pos")).alias("lost"))
    d, null, th, cut = fresh([*base.columns, *out], "d", "null", "th", "cut")
    keyed = base.withColumns({d: F.coalesce(F.col(id_col), F.lit(-1)), null: F.col(id_col).isNull(), th: F.xxhash64(text)})
    lost = lost.select(F.coalesce("d", F.lit(-1)).alias(d), F.col("d").isNull().alias(null), F.col("th").alias(th), F.col("lost").alias(cut))
    joined = keyed.join(lost, [d, null, th], "left")
    n = F.size(F.split(text, "\n"))
    cuts = F.col(cut)
    # the outer transform over one element binds the split text once, as a variable of the inner lambda
    between = lambda all_lines: F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), cuts), F.concat(cuts, F.array(n)), lambda a, b: F.slice(all_lines, a + 2, b - a - 1)))
    kept = F.transform(F.array(F.split(text, "\n")), between)[0]
    dropped = F.greatest(F.coalesce(F.size(cuts), F.lit(0)), F.lit(0)).cast("long")
    joined = joined.withColumns({"n_lines": n.cast("long"), "n_dropped": dropped, "kept_text": F.when(cuts.isNull(), text).otherwise(F.array_join(kept, "\n"))})
    return joined.drop(d, null, th, cut)
