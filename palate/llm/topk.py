"""Exact top-k inner products, score at a time over impact-ordered posting segments.

Vectors are integers. In each block of candidates every dimension has posting lists of (vector, value), one for each power of two of
the absolute value, its quantised impact. Lists are taken in descending impact, and only those of dimensions that a query uses; all
queries of a batch add up partial scores together. After each impact a vector's true score lies within |query| * |its values of
smaller impact| of the partial one (Cauchy-Schwarz), with the norm of the rest stored in the index. Processing stops only on proof:
when so few vectors can still reach the k-th best lower bound that scoring them exactly is cheaper than going on. Those, and all of
them, are scored again in integers.

Each candidate row goes to one task, which builds the index of its block once; the queries, which go to every block as an exact search
must, stream past it in batches. The best k of a block go to one ranking by query.

Odd cases: vectors that are null or hold null or non-finite components take no part; empty vectors do, with score 0; vectors of
unequal length are compared as if the shorter ended in zeros; equal scores are ranked by the smaller id; a query's own id is no
candidate; rows without an id are left out; repeated rows are ranked as the rows they are; fewer than k candidates give all of them;
empty tables give no rows; scores beyond 62 bits are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, staged

#: Candidates of a block: at most, and no fewer where there are cores to spare; queries whose partial scores are held at once.
CANDIDATES, LEAST_BLOCK, AT_ONCE = 32_768, 2_048, 64
#: Share of a block's vectors that may still reach the top for the exact scoring to take over.
FEW = 0.02


class ImpactIndex:
    """A block of candidates (ids ascending) as posting lists of descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        values = self.vectors.astype(float)
        impact = np.frexp(np.abs(values))[1]  # the power of two above each value
        impact[values == 0] = np.iinfo(impact.dtype).min
        rest = (values**2).sum(1)
        self.norms = np.sqrt(rest)
        #: For each impact: the lists (dimension, rows, values), and the norm of what is left of each vector after it.
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        for level in sorted({*np.unique(impact).tolist()} - {np.iinfo(impact.dtype).min}, reverse=True):
            dims, rows = np.nonzero(impact.T == level)
            found = values[rows, dims]
            rest = rest - np.bincount(rows, found**2, len(rest))
            starts = np.flatnonzero(np.diff(dims, prepend=-1)).tolist()
            lists = [(int(dims[a]), rows[a:b], found[a:b]) for a, b in zip(starts, [*starts[1:], len(dims)], strict=True)]
            self.segments.append((lists, np.sqrt(np.maximum(rest, 0))))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, vector ids, scores) of each query's best k here, by score and then id."""
        n, width = self.vectors.shape
        queries = np.pad(queries[:, :width], ((0, 0), (0, max(0, width - queries.shape[1]))))
        for at in range(0, len(query_ids), AT_ONCE):
            ids, q = query_ids[at : at + AT_ONCE], queries[at : at + AT_ONCE]
            qf = np.ascontiguousarray(q.T.astype(float))
            norm = np.sqrt((qf**2).sum(0))
            if self.norms.max(initial=0) * norm.max(initial=0) >= 2.0**62:
                raise OverflowError("scores beyond 62 bits")
            partial = np.zeros((n, len(q)))
            top = min(k + int((self.ids[:, None] == ids[None, :]).sum(0).max(initial=0)), n)  # a query's own rows may be among the best
            may = np.ones((n, len(q)), bool)
            blur = 1e-12 * self.norms.max(initial=0) * norm + 1e-6  # of the partial sums
            for lists, rest in self.segments:
                for d, rows, values in lists:
                    if qf[d].any():
                        partial[rows] += values[:, None] * qf[d]
                slack = rest[:, None] * norm[None, :] + blur
                floor = np.partition(partial - slack, n - top, axis=0)[n - top]
                may = partial + slack >= floor
                if may.sum() <= max(FEW * may.size, (top + 4) * len(q)):
                    break
            for i in range(len(q)):
                rows = np.flatnonzero(may[:, i] & (self.ids != ids[i]))
                scores = self.vectors[rows] @ q[i]
                best = np.lexsort((self.ids[rows], -scores))[:k]
                yield np.full(len(best), ids[i]), self.ids[rows][best], scores[best]


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _block_search(k: int):
    """mapInArrow over (block, asked, id, v) sorted by block and asked: the candidates of a block, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index = None, [], None
        for batch in batches:
            of, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1) | np.diff(asked.astype(np.int8), prepend=asked[:1].astype(np.int8)) != 0)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
                part = batch.slice(a, b - a)
                if of[a] != block:
                    block, held, index = of[a], [], None
                if not asked[a]:
                    held.append(part)
                    continue
                if index is None and held:
                    own = pa.Table.from_batches(held).combine_chunks()
                    index, held = ImpactIndex(own.column(2).to_numpy(), _matrix(own.column(3).combine_chunks())), []
                if index is not None:
                    for found in index.search(part.column(2).to_numpy(), _matrix(part.column(3)), k):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the exact top k of each query among all candidates but its own id. Vectors: array<bigint>."""
    ship_package(candidates.sparkSession)
    spark = candidates.sparkSession
    plain = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    c = staged(plain(candidates).withColumn("row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    n = c.count()
    blocks = max(1, -(-n // CANDIDATES), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    own = c.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.lit(False).alias("asked"), "id", "v")
    asked = staged(plain(queries)).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asked"), "id", "v")
    near = own.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked").mapInArrow(_block_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def to_integers(df: DataFrame, vector_col: str = "embedding", scale: float = 64) -> DataFrame:
    """Components as floor(scale * x), computed in double; vectors that are null or hold null or non-finite components go."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vector_col).isNotNull() & finite).withColumn(vector_col, F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))
