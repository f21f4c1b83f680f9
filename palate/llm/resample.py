"""Importance resampling towards a target distribution of hashed n-grams.

Features are all runs of one to ``n`` consecutive words, hashed into ``buckets``. A bucket's gain is the log ratio of its smoothed
share of the target's features to its share of the corpus'; a document's weight is the mean gain of its features. Scores are weights
plus Gumbel noise from a hash of the id, so the highest scores are a draw without replacement in proportion to exp(weight).

1. Texts are skewed, so long ones are chunked: they are split at word boundaries into chunks of ``CHUNK_BYTES``, each with the next
   n - 1 words as carry. A chunk owns the positions of its own words; a feature counts where it starts, so every feature is counted
   in one chunk exactly and none is cut in two. Chunks are dealt out over the cluster and written once; short texts are read in place.
2. Counts of buckets are summed up in each task before they are shuffled: 10,000 rows a task whatever the input.
3. Sums of gains by chunk are summed up by document. Only (id, counts, sums) shuffle, and only of the chunked documents.
4. The draw: integer scores are counted by value, which gives the score of the last one drawn; what reaches it is sorted by ranges, and
   a rank is the rows of the ranges before plus the place in the own one. No window over all rows.

Odd cases: null and empty texts have no features, weight 0 and are never drawn for lack of words; an empty target leaves gains that
depend on the corpus alone; rows with the same id are documents of their own, each is scored and may be drawn; null ids are hashed
as an empty string and come after others in ties; texts may be of any length; other columns are not looked at by ``draw`` and are
kept by ``resample``, which adds none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, ship_package, slices, staged

N_WORDS, BUCKETS, SEED, PERCENT, MIN_WORDS = 2, 10_000, 7, 25, 20
#: Bytes of text that a chunk owns at least, but for the last one; longer texts are chunked.
CHUNK_BYTES = 1 << 16

#: Digits and letters stay, A-Z lower-cased; all other ASCII becomes a space. Bytes over 127 belong to other letters, which are words, too.
_TO_WORDS = bytes(b if b > 127 or chr(b) in "0123456789" + LOWER else b + 32 if chr(b) in UPPER else 32 for b in range(256))


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def feature_hashes(words: list[bytes], own: int, n: int) -> list[int]:
    """crc32 of every run of one to ``n`` words that starts at one of the first ``own``. The hash of a longer run goes on from that
    of the run without its last word."""
    spaced = [b" " + w for w in words]
    now = list(map(crc32, words[:own]))
    out = list(now)
    for k in range(1, n):
        now = list(map(crc32, spaced[k : own + k], now))
        out += now
    return out


def chunks(text: str | None, n: int = N_WORDS, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """The words of a text in chunks (own words, carried words), both joined by spaces. The own words of all chunks are the text's words."""
    plain = b" " + (text or "").encode().translate(_TO_WORDS) + b" "
    starts = [0]
    while len(plain) - starts[-1] > size:
        starts.append(plain.index(b" ", starts[-1] + size))
    for a, b in pairwise([*starts, len(plain)]):
        end = b
        for _ in range(n - 1):  # the next words, however long they and the spaces before them are
            while end < len(plain) and plain[end] == 32:
                end += 1
            end = plain.find(b" ", end) if end < len(plain) else end
        yield plain[a:b].strip(), plain[b:end].strip()


def _counted(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n) of the rows (own, carry): each task sums up before it gives anything out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, carry in _word_lists(batch.column(0), batch.column(1)):
                hashes = np.array(feature_hashes(own + carry, len(own), n), np.int64)
                total += np.bincount(hashes % buckets, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return rows.select("own", "carry").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _word_lists(own: pa.Array, carry: pa.Array) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    for part in slices(own):
        for a, b in zip(part.to_pylist(), carry.slice(at, len(part)).to_pylist(), strict=True):
            yield text_words(a), text_words(b)
        at += len(part)


def _with_sums(rows: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    """Add ``sums``: struct of the words and features that start in own, and the sum of their gains."""
    sent = rows.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    @F.arrow_udf("struct<words:long,features:long,gain:long>")
    def sums(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of = sent.value
        for own, carry in batches:
            out = []
            for mine, more in _word_lists(own, carry):
                hashes = np.array(feature_hashes(mine + more, len(mine), n), np.int64)
                out.append((len(mine), len(hashes), int(of[hashes % len(of)].sum())))
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], ["words", "features", "gain"])

    return rows.withColumn("sums", sums(F.col("own"), F.col("carry")))


def _split(docs: DataFrame, id_col: str, text_col: str, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are, (id, h1, h2, own, carry), and the chunks of long ones, which also have their number ``pos``, dealt out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(SEED), text).alias("h2"), text.alias("own"), F.lit("").alias("carry"))
    long = F.octet_length("own") > size

    @F.arrow_udf("array<struct<own:string,carry:string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("own", pa.string()), ("carry", pa.string())]))
        for batch in batches:
            for one in range(len(batch)):  # long texts: one at a time
                yield pa.array([[{"own": a.decode(), "carry": b.decode()} for a, b in chunks(batch[one].as_py(), n, size)]], kind)

    made = base.filter(long).select("id", "h1", "h2", F.posexplode(cut(F.col("own"))).alias("pos", "c"))
    dealt = made.select("id", "h1", "h2", "pos", "c.own", "c.carry").repartition("id", "h1", "h2", "pos")
    return base.filter(~long), staged(dealt)


def _totals(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int, size: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    short, long = _split(docs, id_col, text_col, n, size)
    counted = _counted(short, n, buckets).unionByName(_counted(long, n, buckets))
    found = np.zeros(buckets, np.int64)
    for r in counted.collect():  # two rows a bucket at most
        found[r.bucket] += r.n
    return found, short, long


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths of a nat, rounded down, from how many features of the corpus and of the target it holds."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = N_WORDS, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, h1, h2, n_words, n_features, weight) of every row; h1 and h2 are hashes of its text."""
    ship_package(docs.sparkSession)
    corpus, short, long = _totals(docs, id_col, text_col, n, buckets, chunk_bytes)
    wanted, *_ = _totals(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text", n, buckets, chunk_bytes)
    of = gains(corpus, wanted)
    total = lambda c: F.sum(f"sums.{c}").alias(c)
    # rows equal in id and text are summed up as one and dealt out again, each with its share
    summed = _with_sums(long, of, n).groupBy("id", "h1", "h2").agg(total("words"), total("features"), total("gain"), F.count_if(F.col("pos") == 0).alias("rows"))
    share = [F.expr(f"{c} div rows").alias(c) for c in ("words", "features", "gain")]
    summed = summed.select("id", "h1", "h2", *share, F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")
    both = _with_sums(short, of, n).select("id", "h1", "h2", "sums.*").unionByName(summed)
    mean = F.when(F.col("features") > 0, F.expr("(gain - pmod(gain, features)) div features")).otherwise(0).cast("long")
    return both.select("id", "h1", "h2", F.col("words").alias("n_words"), F.col("features").alias("n_features"), mean.alias("weight"))


def ranked(scored: DataFrame, wanted: int | None = None, percent: int = PERCENT) -> DataFrame:
    """Add ``rank`` to rows (id, score, may): the place among those that may be drawn, highest score first, then smallest id; null beyond
    ``percent`` of them. ``scored`` has to be a written table, since it is read several times."""
    by_score = scored.filter("may").groupBy("score").count().orderBy(F.desc("score")).collect()  # scores are logarithms in thousandths: their range is some 10^5
    wanted = percent * sum(r["count"] for r in by_score) // 100 if wanted is None else wanted
    least, seen = None, 0
    for r in by_score:
        if seen < wanted:
            least, seen = r["score"], seen + r["count"]
    reach = F.col("may") & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    placed = staged(scored.filter(reach).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, place = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        sizes.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(sizes, "part int, before long"))
    rank = F.col("before") + place + 1
    out = placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.when(rank <= wanted, rank)).drop("place", "part", "before")
    return out.unionByName(scored.filter(~F.coalesce(reach, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def draw(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = N_WORDS, buckets: int = BUCKETS,
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id, n_features, weight, score, rank, h1, h2) of every document; rank is null for those not drawn. ``percent`` of the documents of at
    least ``min_words`` words are drawn, rounded down."""
    of = weights(docs, target, id_col, text_col, target_col, n, buckets, chunk_bytes)
    scored = staged(of.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("may", F.col("n_words") >= min_words).drop("n_words"))
    return ranked(scored, percent=percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "h1", "h2")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, whole; of rows equal in id and text, as many as are drawn."""
    found = draw(docs, target, id_col, text_col, **how)
    groups = found.groupBy(F.col(id_col).alias("d"), "h1", "h2").agg(F.count("rank").alias("drawn"), F.count("*").alias("all")).filter("drawn > 0")
    k1, k2 = fresh([*docs.columns, "d", "h1", "h2"], "k1", "k2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(SEED), text)})
    of = lambda g: base.join(g, base[id_col].eqNullSafe(g["d"]) & (base[k1] == g["h1"]) & (base[k2] == g["h2"]), "left_semi").drop(k1, k2)
    whole, cut = of(groups.filter(F.col("drawn") == F.col("all"))), groups.filter(F.col("drawn") < F.col("all"))
    last = cut.first()  # equal rows have neighbouring ranks, so the end of the draw goes through one group at most
    return whole if last is None else whole.unionByName(of(cut).limit(last["drawn"]))
