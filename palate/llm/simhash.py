"""SimHash near-duplicates with bit-sliced comparison.

1. Fingerprints: one pass over whole texts (NumPy inside Arrow batches).
2. Equal fingerprints collapse with partial aggregation to one node, the smallest id; only distinct fingerprints are compared.
3. Candidates, exactly: the 64 bits are cut into more blocks than the radius. Two fingerprints within the radius agree on some blocks
   (radius + 2 blocks: on two, radius + 3: on three, ...), so each goes once into the table of every choice of so many blocks. The
   more fingerprints there are, the more blocks, so that buckets stay small: 15 tables of 21 bits, 35 of 27 or 70 of 32 for radius 4.
4. Buckets over ``CHUNK`` fingerprints are dealt out as all pairs of their chunks, so no task gets an unbounded group.
5. Inside a bucket the fingerprints are stored as 64 bit planes, once. Many distances are updated at once: planes, inverted where a
   probe's bit is set or shifted against one another, are added into bitwise counters with carry-save adders; a block of words is
   given up once all of its counters are over the radius. Only edges of a spanning forest leave a bucket.
6. Components by alternating large-star and small-star rounds on the edge table, each checkpointed.

``near_duplicates`` links fingerprints within a radius, exactly. ``similar_documents`` links texts whose sets of word shingles overlap
by a given share (Jaccard). An overlap of 0.8 is some 4 to 16 bits of 64, which no two shared blocks promise, so texts meet under keys
of their least shingle hashes instead (see ``least_keys``), and are compared there as above; every link is then checked exactly.

Odd cases: null text, empty text and text without words have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle; equal rows and equal ids are fine (each row is returned); null ids are returned with their own
fingerprint and the component of the numbered documents it belongs to (null if there are none); empty tables give empty results;
extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, ship_package, slices, staged

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a bucket that one task compares with one another; larger buckets go out as pairs of chunks.
CHUNK = 4096
#: Words of 64 fingerprints that the carry-save counters handle at a time.
BLOCK_WORDS = 512
#: Fingerprints of a bucket whose pairs are compared by shifting its planes against themselves.
MODERATE = 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of the ASCII-lower-cased text, in order; fewer words than a shingle make one."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    of = xxhash.xxh64_intdigest
    return np.array([of(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values (rows, words) have each bit set. Carry-save adders turn three rows of a weight into one and a carry."""
    total, weight = np.zeros(64 * h.shape[1], np.int64), 1
    while len(h):
        carries = []
        while len(h) > 2:
            m = len(h) // 3
            a, b, c = h[:m], h[m : 2 * m], h[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            h = np.concatenate([half ^ c, h[3 * m :]])
        total += weight * np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
        h = np.concatenate(carries) if carries else h[:0]
        weight *= 2
    return total


def majority(h: np.ndarray) -> np.ndarray:
    """The words whose bits are set in over half of the rows."""
    return np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes; 0 without words."""
    h = shingle_hashes(text, shingle)
    return int(majority(h[:, None])[0]) if len(h) else 0


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """Majority bits of ``words`` independent hashes, each mixed from the first one."""
    if not len(h):
        return np.zeros(words, np.uint64)
    z = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(z ^ (z >> np.uint64(31)))


def fingerprint_column(text_col: str = "text", shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                yield pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())

    return of(F.col(text_col))


def _near(plane: Callable[[int, slice], np.ndarray], live: np.ndarray, radius: int) -> np.ndarray:
    """The live rows of whose 64 planes of differing bits at most ``radius`` are set, ascending. ``plane(k, at)``: words of plane k."""
    found = []
    for at in range(0, len(live), BLOCK_WORDS):
        block = slice(at, at + BLOCK_WORDS)
        out = ~live[block]  # rows that are out already: not live, or past what the counters hold
        counters = [np.zeros_like(out) for _ in range(max(2, radius.bit_length()))]
        for b in range(0, 64, 8):
            if not (~out).any():  # all of the block is past the radius: give it up
                break
            for k in range(b, b + 8, 2):
                # full adder of two planes and the lowest counter, then ripple the carry
                x, y, low = plane(k, block), plane(k + 1, block), counters[0]
                half = x ^ y
                carry = (x & y) | (half & low)
                counters[0] = half ^ low
                for c in range(1, len(counters)):
                    counters[c], carry = counters[c] ^ carry, counters[c] & carry
                out |= carry
            out |= _beyond(counters, radius)
        else:
            found.append(np.flatnonzero(np.unpackbits((~out).view(np.uint8), bitorder="little")) + at * 64)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bitwise comparison of the counters with the radius: set where the count is larger."""
    greater, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for c in range(len(counters) - 1, -1, -1):
        if radius >> c & 1:
            equal &= counters[c]
        else:
            greater |= equal & counters[c]
            equal &= ~counters[c]
    return greater


def _packed(rows: np.ndarray) -> np.ndarray:
    """Booleans as words of 64, the last one filled up with zeros."""
    padded = np.zeros((len(rows) + 63) // 64 * 64, np.uint8)
    padded[: len(rows)] = rows
    return np.packbits(padded, bitorder="little").view(np.uint64)


class BitPlanes:
    """Fingerprints stored by bit: plane b holds bit b of 64 fingerprints a word."""

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        self.words = (self.n + 63) // 64
        bits = np.zeros((self.words * 64, 64), np.uint8)
        bits[: self.n] = np.unpackbits(prints.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64).reshape(64, self.words)
        self.live = _packed(np.ones(self.n, bool))

    def drop(self, rows: np.ndarray) -> None:
        np.bitwise_and.at(self.live, rows // 64, ~(np.uint64(1) << (rows % 64).astype(np.uint64)))

    def within(self, value: int, radius: int) -> np.ndarray:
        """Live rows within the radius of a fingerprint."""
        return _near(lambda k, at: ~self.planes[k, at] if value >> k & 1 else self.planes[k, at], self.live, radius)

    def within_of_next(self, d: int, rows: np.ndarray, radius: int) -> np.ndarray:
        """Those of the rows (booleans) that lie within the radius of the row ``d`` further on. Only words with any such row are read."""
        live = _packed(rows)
        used = np.flatnonzero(live)
        far, near = used + d // 64, np.uint64(d % 64)
        reach = lambda k, w: np.where(w < self.words, self.planes[k][np.minimum(w, self.words - 1)], np.uint64(0))

        def apart(k: int, at: slice) -> np.ndarray:
            w = far[at]
            next_ = reach(k, w) if not near else (reach(k, w) >> near) | (reach(k, w + 1) << (np.uint64(64) - near))
            return self.planes[k][used[at]] ^ next_

        found = _near(apart, live[used], radius)
        return used[found // 64] * 64 + found % 64


def spanning_edges(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the distinct fingerprints that lie within the radius of one another."""
    planes, edges = BitPlanes(prints), []
    values = prints.astype(np.uint64).tolist()
    waiting = np.ones(len(values), bool)
    left = len(values)
    for root in range(len(values)):
        if not waiting[root]:
            continue
        front = [root]
        waiting[root] = False
        planes.drop(np.array([root]))
        left -= 1
        while front and left:
            row = front.pop()
            near = planes.within(values[row], radius)
            if len(near):
                planes.drop(near)
                waiting[near] = False
                left -= len(near)
                edges += [(row, int(x)) for x in near]
                front += near.tolist()
        if not left:
            break
    return edges


def _bulk_links(prints: np.ndarray, sizes: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For buckets of moderate size: the bit planes of all rows against the row d further on in their bucket, for d = 1, 2, ..."""
    a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.zeros(len(prints), np.int64)  # rows from here to the end of the bucket
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        left[s : s + n] = np.arange(n, 0, -1)
    planes = BitPlanes(prints)
    for d in range(1, int(sizes.max(initial=1))):
        near = planes.within_of_next(d, left > d, radius)
        a_all.append(near)
        b_all.append(near + d)
    return np.concatenate(a_all), np.concatenate(b_all)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the linked pairs make a spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[y], kept[k] = x, True
    return kept


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket (the first column), cut between buckets. A bucket may run on into the next batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != bucket[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = np.flatnonzero(bucket != bucket[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket starts, and its rows."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(bucket)]]))


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bucket_edges(radius: int, moderate: int = MODERATE):
    """mapInArrow over (bucket, fp, node) sorted by bucket: tree edges between the nodes of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            bucket, prints, nodes = (column.to_numpy() for column in table.columns)
            starts, sizes = _bounds(bucket)
            prints = prints.view(np.uint64)
            few = (sizes > 1) & (sizes <= moderate)
            a, b = _bulk_links(prints, sizes[few], starts[few], radius)
            tree = _forest(a, b)
            out_a, out_b = [nodes[a[tree]]], [nodes[b[tree]]]
            for s, n in zip(starts[sizes > moderate], sizes[sizes > moderate], strict=True):
                if found := spanning_edges(prints[s : s + n], radius):
                    pair = np.array(found) + s
                    out_a.append(nodes[pair[:, 0]])
                    out_b.append(nodes[pair[:, 1]])
            yield _edge_batch(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_chunks(rows: DataFrame, chunks: Column, pairs: bool) -> DataFrame:
    """Deal the rows of each key (key, node, ...) into its chunks, by a hash of the node that differs from key to key: a chunk by itself
    or, with ``pairs``, in the pair with each other chunk. Gives (bucket, ...) in place of key."""
    rest = [c for c in rows.columns if c != "key"]
    mine = F.pmod(F.xxhash64("key", "node"), F.col("k")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.least(mine, o) * F.col("k") + F.greatest(mine, o))
    dealt = rows.withColumn("k", chunks.cast("int"))
    dealt = dealt.select(*rest, "key", F.explode(F.when(F.col("k") > 1, pair if pairs else F.array(mine)).otherwise(F.array(F.lit(0)))).alias("part"))
    return dealt.select(F.xxhash64("key", "part").alias("bucket"), *rest).repartition("bucket")


def near_edges(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, n: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that join all fingerprints within the radius of one another.

    n: how many there are (counted if not given); the blocks are so many that a table has more keys than an eighth of it.
    """
    ship_package(nodes.sparkSession)
    n = nodes.count() if n is None else n
    agree = next((k for k in (2, 3, 4) if 8 << (64 * k // (radius + k)) >= n), 4)
    blocks = radius + agree
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]

    def key(t: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(t)  # the tables are told apart by a hash, so bits of any width fit
        return F.xxhash64(out, *(F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in chosen))

    keys = [key(t, chosen) for t, chosen in enumerate(combinations(range(blocks), agree))]
    keyed = nodes.select("fp", F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    dealt = _in_chunks(keyed.join(sizes, "key").select("key", "fp", "node", "n"), F.ceil(F.col("n") / chunk), True)
    return _ordered(dealt.select("bucket", "fp", "node").sortWithinPartitions("bucket", "fp", "node").mapInArrow(_bucket_edges(radius), "a long, b long"))


#: Edges that a task reads at least in the rounds of ``components``, where there are more tasks than cores.
A_TASK = 50_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component): the smallest node that each node of the edges (a, b) reaches, by large-star and small-star rounds.

    Tables of a round have as many partitions as a shuffle has, however few edges are left. They are read in tasks by their edges, for
    the driver keeps notes of every task."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == before or not size[0]:
            break
        before = tuple(size)
        tasks = max(cores, size[0] // A_TASK)
        both = now.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        # a checkpointed side gets an exchange of its own, so that a join on a hub is split
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))).coalesce(tasks)
        large = checkpointed(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()).coalesce(tasks)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(now.select(F.col("v"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of every row; fp is the fingerprint as a signed long. Links run between fingerprints, so rows without an
    id link others, too."""
    ship_package(docs.sparkSession)
    prints = staged(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp")))
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("node")))
    edges = near_edges(nodes.select("fp"), radius)
    groups = components(edges)
    labelled = staged(nodes.join(groups, nodes["fp"] == groups["v"], "left").select("fp", "node", F.coalesce("component", "fp").alias("root")))
    least = staged(labelled.groupBy("root").agg(F.min("node").alias("component_id")))
    return prints.join(labelled.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Words of the wide fingerprint of ``similar_documents``; the bits of its first word and of all words that candidates may differ in.
#: At an overlap of 0.8 in 100 bits 15 differ, in texts of a few shingles 19: means of 9.7 to 12 and 77 to 96, some four standard
#: deviations below. Where both texts have ``MANY`` shingles, the bound of all words is the narrow one.
WIDE, APART, WIDE_APART, MANY, MANY_APART = 8, 24, 134, 64, 114
#: Ranges of the hash space of which the least shingle is taken, and how many neighbouring ranges make a key. Two texts share the least
#: shingle of a range with a chance of their overlap J, a key with J^8: at 0.8, one key of 40 at least with 0.9994, at 0.5 with 0.15.
RANGES, A_KEY = 320, 8
#: The overlap that these numbers are made for; a smaller one is refused.
LEAST_SIMILARITY = 0.8
#: Distinct shingles of a bucket that one task holds; larger buckets go out as pairs of chunks.
HELD = 1 << 20

_RANGE_STARTS = np.array([(k << 64) // RANGES for k in range(RANGES)], np.uint64)
_LENDERS = np.random.default_rng(SEED).permuted(np.tile(np.arange(RANGES, dtype=np.int16), (RANGES, 1)), axis=1)


def least_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of shingles (ascending, not empty). An empty range takes the shingle of the first range that has one in an order
    of its own, so that short texts keep the same chances."""
    at = np.searchsorted(h, _RANGE_STARTS)
    has = at < np.append(at[1:], len(h))
    if not has.all():
        bare = np.flatnonzero(~has)
        lent = _LENDERS[bare]
        at[bare] = at[lent[np.arange(len(bare)), has[lent].argmax(1)]]
    least = h[at].reshape(-1, A_KEY)
    key = np.arange(len(least), dtype=np.uint64) + np.uint64(1)
    for k in range(A_KEY):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def sketch(h: np.ndarray) -> np.ndarray:
    """Of the shingles of a text: 128 bits of their set, its size, its wide fingerprint, and its keys (none without shingles)."""
    h = np.unique(h)
    content = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes(), SEED), np.uint64)
    return np.concatenate([content, np.array([len(h)], np.uint64), wide_fingerprint(h, WIDE), least_keys(h) if len(h) else h])


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.uint64)]).view(np.int64)))


def _shingles_column(text_col: str, shingle: int, of_shingles: Callable[[np.ndarray], np.ndarray]) -> Column:
    """``of_shingles`` of each text's shingle hashes."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch):
                yield _long_lists([of_shingles(shingle_hashes(t, shingle)) for t in texts.to_pylist()])

    return of(F.col(text_col))


def _bucket_stars(radius: int):
    """mapInArrow over (bucket, fp, node) sorted by bucket: each bucket's nodes that lie within the radius of its central one, as edges.

    The central node is the one nearest to the majority of the bucket's bits. All rows of a batch are compared at once: bit planes of
    what differs from the own centre.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            bucket, prints, nodes = (column.to_numpy() for column in table.columns)
            starts, sizes = _bounds(bucket)
            prints, of = prints.view(np.uint64), np.repeat(np.arange(len(starts)), sizes)
            bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            common = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None]
            middle = np.packbits(common, axis=1, bitorder="little").view(np.uint64).ravel()
            order = np.lexsort((nodes, np.bitwise_count(prints ^ middle[of]), of))
            centre = order[starts][of]
            planes = BitPlanes(prints ^ prints[centre])
            near = planes.within(0, radius)
            near = near[near != centre[near]]
            yield _edge_batch(nodes[centre[near]], nodes[near])

    return run


def _root(of: dict[int, int], x: int) -> int:
    while (up := of.setdefault(x, x)) != x:
        of[x] = x = of[up]
    return x


def _overlaps(own: np.ndarray, other: list[np.ndarray]) -> np.ndarray:
    """How many values of each of the others are in ``own`` (ascending)."""
    flat = np.concatenate(other)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum([0, *map(len, other[:-1])]))


def _bucket_links(radius: int, similarity: float):
    """mapInArrow over (bucket, fp, node, label, wide, shingles) sorted by bucket: checked links between nodes of different labels.

    Each node is compared with all others at once by bit planes; of those within the radius that it is not yet joined with, the nearest
    is checked first, then twice as many each time. A link joins its labels, so only links that join anything are given, and a
    bucket of near copies costs about one check a node.
    """

    def links(prints: np.ndarray, nodes: np.ndarray, label: np.ndarray, wide: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        planes, size, joined, out = BitPlanes(prints), np.array(list(map(len, sets))), {}, []
        values, root = prints.tolist(), label.copy()
        for i in range(len(nodes)):
            planes.drop(np.array([i]))
            if (root == root[i]).all():
                break
            near = planes.within(values[i], radius)
            near = near[(root[near] != root[i]) & (np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]))]
            apart = np.bitwise_count(wide[near] ^ wide[i]).sum(1, dtype=np.int64)
            close = apart <= np.where(np.minimum(size[near], size[i]) >= MANY, MANY_APART, WIDE_APART)
            near = near[close][np.argsort(apart[close], kind="stable")]
            step = 1
            while len(near):
                now, near = near[:step], near[step:]
                both = _overlaps(sets[i], [sets[j] for j in now])
                for j in now[both >= similarity * (size[now] + size[i] - both)].tolist():
                    if root[j] != root[i]:
                        out.append((int(nodes[i]), int(nodes[j])))
                        joined[_root(joined, int(root[j]))] = _root(joined, int(root[i]))
                        root[root == root[j]] = root[i]
                near, step = near[root[near] != root[i]], 2 * step
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            bucket, prints, nodes, label = (table.column(k).to_numpy() for k in range(4))
            wide, lists = (table.column(k).combine_chunks() for k in (4, 5))
            wide = np.ascontiguousarray(wide.flatten().to_numpy()).view(np.uint64).reshape(-1, WIDE)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            flat = lists.flatten().to_numpy().view(np.uint64)
            found = []
            for s, n in zip(*(x.tolist() for x in _bounds(bucket)), strict=True):
                if len(np.unique(label[s : s + n])) > 1:
                    found += links(prints[s : s + n].view(np.uint64), nodes[s : s + n], label[s : s + n], wide[s : s + n], [flat[ends[r] : ends[r + 1]] for r in range(s, s + n)])
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield _edge_batch(pairs[:, 0], pairs[:, 1])

    return run


def _checked(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose wide fingerprints are near and whose sets of shingles overlap by ``similarity``. The fingerprints
    go first, so that sets travel for few pairs."""
    side = lambda own, *cols: sets.select(F.col("node").alias(own), *(F.col(c).alias(f"{c}_{own}") for c in cols))
    pairs = met.join(side("a", "wide"), "a").join(side("b", "wide"), "b")
    distance = sum((F.bit_count(F.col("wide_a")[k].bitwiseXOR(F.col("wide_b")[k])) for k in range(WIDE)), F.lit(0))
    pairs = checkpointed(pairs.filter(distance <= WIDE_APART).select("a", "b"))
    pairs = pairs.join(side("a", "s"), "a").join(side("b", "s"), "b")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return checkpointed(pairs.filter(both >= similarity * (F.size("s_a") + F.size("s_b") - both)).select("a", "b"))


def _text_hashes(text: Column) -> list[Column]:
    """128 bits of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, held: int) -> DataFrame:
    """(id, t1, t2, first) of every row: its id, the hashes of its text, and the same three of the first row of its group, as a struct:
    numbered rows before others, by id, then by the hashes."""
    if not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"keys and bounds hold for a similarity of {LEAST_SIMILARITY} to 1")
    ship_package(docs.sparkSession)
    t1, t2 = _text_hashes(F.col(text_col))
    w = F.col("w")
    made = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), _shingles_column(text_col, shingle, sketch).alias("w"))
    prints = staged(made.select("id", "t1", "t2", w[0].alias("c1"), w[1].alias("c2"), w[2].alias("size"), F.slice("w", 4, WIDE).alias("wide"), F.slice("w", 4 + WIDE, RANGES // A_KEY).alias("keys")))
    least = F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "t1", "t2"))
    nodes = prints.groupBy("c1", "c2").agg(least.alias("first"), F.max("size").alias("size"), F.first("wide").alias("wide"), F.first("keys").alias("keys"))  # equal sets, equal sketches
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.col("wide")[0].alias("fp"), "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    met = staged(keyed.join(shared, "key"))

    own = met.select("node").distinct().join(nodes.select("node", "wide", "first"), "node")
    texts = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    row = own.select("node", "wide", F.col("first.id").alias("i"), F.col("first.t1").alias("h1"), F.col("first.t2").alias("h2"))
    asked = texts.join(row, texts["id"].eqNullSafe(row["i"]) & (texts["t1"] == row["h1"]) & (texts["t2"] == row["h2"])).dropDuplicates(["node"])
    sets = staged(asked.select("node", "wide", _shingles_column("text", shingle, np.unique).alias("s")))

    stars = _in_chunks(met.select("key", "fp", "node", "n"), F.ceil(F.col("n") / CHUNK), False)
    offered = _ordered(stars.select("bucket", "fp", "node").sortWithinPartitions("bucket", "node").mapInArrow(_bucket_stars(APART), "a long, b long"))
    alike = _checked(offered, sets, similarity)

    # what the stars have not joined: buckets of more than one label, each set of members once
    now = components(alike)
    labelled = staged(met.join(now, met["node"] == now["v"], "left").select("key", "fp", "node", "total", F.coalesce("component", "node").alias("label")))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"m{k}") for k in (1, 2)), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.filter("lo <> hi").groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    rows = _in_chunks(labelled.join(mixed, "key").join(sets, "node").select("key", "fp", "node", "label", "wide", "s", "total"), F.ceil(F.col("total") / held), True)
    rows = rows.select("bucket", "fp", "node", "label", "wide", "s").sortWithinPartitions("bucket", "label", "node")
    rest = checkpointed(_ordered(rows.mapInArrow(_bucket_links(APART, similarity), "a long, b long")))

    groups = components(alike.unionByName(rest))
    labels = nodes.join(groups, nodes["node"] == groups["v"], "left").select("c1", "c2", F.coalesce("component", "node").alias("component"), "first")
    best = labels.groupBy("component").agg(F.min("first").alias("first"))
    labels = labels.select("c1", "c2", "component").join(best, "component").select("c1", "c2", "first")
    return prints.select("id", "t1", "t2", "c1", "c2").join(labels, ["c1", "c2"]).select("id", "t1", "t2", "first")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, held: int = HELD) -> DataFrame:
    """(id, component_id): documents whose sets of shingles overlap by ``similarity`` or more (Jaccard), and what they reach.

    Every link is checked exactly, before anything is joined by it. In each bucket, nodes first meet its central one; buckets whose
    nodes are then still of several groups are searched with the sets at hand, where a link that joins nothing is not given out.
    Finding candidates is a matter of chance: at an overlap of 0.8, 999 of 1,000 pairs share a key, and more above. Texts
    without a word are copies of one another. Texts of one set of shingles (128 bits of it) count as copies without a further check.
    Null ids take part as in ``near_duplicates``.
    """
    return _groups(docs, id_col, text_col, shingle, similarity, held).select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``similar_documents`` the first row stays, by id (null last).

    The choice is made by row, not by id: rows that share an id but not a group each stay, if first in theirs. Of rows equal in id
    and text one stays. Texts travel only where rows are repeated; the others are kept or dropped where they lie, or by an anti-join.
    """
    k1, k2 = fresh([*docs.columns, "id", "t1", "t2"], "k1", "k2")
    rows = _groups(docs, id_col, text_col, shingle, similarity, HELD)
    by_row = rows.groupBy("id", "t1", "t2").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    out = staged(by_row.select("id", "t1", "t2", stays.alias("stays"), (F.col("n") > 1).alias("repeated")).filter("repeated or not stays"))
    h1, h2 = _text_hashes(F.col(text_col))
    base = docs.withColumns({k1: h1, k2: h2})
    same = lambda other: base[id_col].eqNullSafe(other["id"]) & (base[k1] == other["t1"]) & (base[k2] == other["t2"])
    single = base.join(out, same(out), "left_anti")
    twice = out.filter("repeated and stays")
    repeated = base.join(twice, same(twice), "left_semi").dropDuplicates([id_col, k1, k2])
    return single.unionByName(repeated).drop(k1, k2)
