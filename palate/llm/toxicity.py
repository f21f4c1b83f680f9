"""Toxicity by a second-order factorization machine over hashed terms.

Terms are the words of a text and their beginnings (inflected insults share those), hashed and taken once a text. On a bounded
sample of labelled texts, Spark counts which terms go with the label; the telling ones become the machine's inputs, so that a long
text is not judged by thousands of noise terms. A term that tells nothing by itself becomes an input, too, if beside another term it
changes what that one says. Linear weights and pairwise factors are then fitted with Adam in NumPy; the factors
learn what linear weights cannot, such as an insult that counts beside the mention of a group only.

Odd cases: null and empty texts get the score of the bias alone; without labels, or with labels of one kind, every text gets the
smoothed base rate; repeated rows get equal scores; texts are read whole; other columns stay (those named as an output are replaced).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, ship_package, slices, staged_at

#: Hash buckets (a power of two), labelled documents that teach at most, inputs of the machine at most, factors.
BUCKETS, MAX_TRAIN, MAX_TERMS, FACTORS = 1 << 18, 20_000, 4_096, 6
STEPS, RATE, DECAY, SEED = 150, 0.1, 2e-3, 11
#: Entries (a text's input each) whose weights and factors are gathered at a time as the machine is fitted: some 4 MB.
GATHERED = 1 << 16
#: Least documents of a term, least association with the label (G-squared) and least change of the odds for it to become an input.
MIN_DOCS, MIN_GAIN, MIN_ODDS = 2, 8.0, 2.0
#: Terms (the most frequent ones and the telling ones) whose pairs are looked at and taught rows to look at them in, least documents
#: with both, one or none of a pair, least evidence (z squared) that two terms say together what the telling ones have missed, and
#: inputs at most that come by pairs.
PAIR_TERMS, PAIR_ROWS, PAIR_DOCS, PAIR_GAIN, MAX_PAIRED = 2_048, 6_000, 5, 32.0, 256
PREFIXES = (3, 4, 5, 6)
#: Characters of words that a worker remembers the terms of: some 25 MB.
KNOWN_CHARS = 1_500_000

_WORD = re.compile(r"[^\W\d_]+")


def _buckets(word: str) -> list[int]:
    return [zlib.crc32(t.encode()) & (BUCKETS - 1) for t in (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k))]


class _Known(dict):
    """Word -> its terms as int32 bytes: their buckets or, with ``place``, the inputs among them, which most words have none of."""

    def __init__(self, place: np.ndarray | None = None):
        super().__init__()
        self.inputs = None if place is None else {int(b): int(place[b]) for b in np.flatnonzero(place >= 0)}
        self.chars = 0

    def __missing__(self, word: str) -> bytes:
        terms = _buckets(word)
        if self.inputs is not None:
            terms = [self.inputs[b] for b in terms if b in self.inputs]
        out = array("i", terms).tobytes() if terms else b""
        if len(word) <= 64:
            if self.chars > KNOWN_CHARS:
                self.clear()
                self.chars = 0
            self[word] = out
            self.chars += len(word)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The distinct terms of a text, ascending."""
        words = set(_WORD.findall((text or "").lower()))
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32))


_kept: dict[bytes, _Known] = {}


def _known(place: np.ndarray) -> _Known:
    """What a worker process remembers for the machine that it served last, from task to task; ``KNOWN_CHARS`` bound it."""
    key = hashlib.sha256(place.tobytes()).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Known(place)
    return _kept[key]


def hashed_terms(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's terms, ascending."""
    return _Known().of(text)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32), pa.int32()))


def _term_column(text_col: str):
    """The distinct buckets of each text."""

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known()
        for batch in batches:
            for texts in slices(batch):
                yield _lists([known.of(t) for t in texts.to_pylist()])

    return of(F.col(text_col))


def _placed(terms_col: str, place: np.ndarray):
    """The inputs among the buckets of each row; there are fewer than 32,768."""

    @F.arrow_udf("array<smallint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield _lists([(x := place[row.values.to_numpy()])[x >= 0] for row in lists]).cast(pa.list_(pa.int16()))

    return of(F.col(terms_col))


@dataclass
class FactorizationMachine:
    bias: float
    place: np.ndarray  # bucket -> input or -1
    linear: np.ndarray
    factors: np.ndarray

    def score(self, text: str | None) -> float:
        return self.of_inputs(_Known(self.place).of(text))

    def of_inputs(self, x: np.ndarray) -> float:
        v = self.factors[x]
        z = self.bias + self.linear[x].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _run_sums(table: np.ndarray, of: np.ndarray, starts: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Put into the rows ``at`` of ``out`` the sums of ``table[of]`` over the runs that begin at ``starts`` (ascending, none empty).
    Whole runs are gathered, ``GATHERED`` entries at a time or one longer run."""
    ends = np.append(starts[1:], len(of))
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + GATHERED, "right")))
        out[at[k:stop]] = np.add.reduceat(np.take(table, of[starts[k] : ends[stop - 1]], axis=0), starts[k:stop] - starts[k], axis=0)
        k = stop


def fit_machine(rows: list[np.ndarray], y: np.ndarray, n_terms: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and factors by full-batch Adam on the logistic loss.

    Weights and factors are one table, a row a term. What a text sums over its terms and a term over its texts are sums over runs of
    neighbouring entries, gathered in parts; the part of a factor's gradient that is its own share of the text's sum leaves the inner sum.
    """
    rng, n = np.random.default_rng(SEED), len(rows)
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32)
    held, row_at = np.flatnonzero(sizes), (np.cumsum(sizes) - sizes)[sizes > 0]
    by_term = np.argsort(cols, kind="stable")
    docs_of = np.bincount(cols, minlength=n_terms)
    terms = np.flatnonzero(docs_of)
    term_at = (np.cumsum(docs_of) - docs_of)[terms]
    text_of = np.repeat(np.arange(n, dtype=np.int32), sizes)[by_term]
    del by_term
    bias = np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    table = np.concatenate([np.zeros((n_terms, 1)), rng.normal(0, 0.01, (n_terms, FACTORS))], 1)  # linear weight, factors
    params = [bias, table]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sums, squares = np.zeros((n, 1 + FACTORS)), np.zeros(n)
    for step in range(1, STEPS + 1):
        if len(cols):
            _run_sums(table, cols, row_at, sums, held)
            _run_sums((table[:, 1:] ** 2).sum(1), cols, row_at, squares, held)
        z = bias[0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        grad = np.zeros_like(table)
        if len(cols):
            weighed = error[:, None] * np.concatenate([np.ones((n, 1)), sums[:, 1:]], 1)
            _run_sums(weighed, text_of, term_at, grad, terms)
            grad[:, 1:] -= table[:, 1:] * grad[:, :1]
        grad += DECAY / n_terms * table
        for k, (p, g) in enumerate(zip(params, (np.array([error.sum()]), grad), strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return float(bias[0]), table[:, 0].copy(), np.ascontiguousarray(table[:, 1:])


def telling_pairs(of: np.ndarray, cols: np.ndarray, y: np.ndarray, p: np.ndarray, n_terms: int) -> np.ndarray:
    """The terms, best first, that together with another term say what the model has missed: the contrast of the mean residuals of the
    texts with both, one and none. of, cols: the document and the term of each entry, documents ascending; p: the model's scores."""
    n, residual = len(y), (y - p).astype(np.float32)
    spread = np.maximum(p * (1 - p), 0.02).astype(np.float32)
    x = np.zeros((n, n_terms), np.uint8)
    x[of, cols] = 1
    weights = np.stack([np.ones(n, np.float32), residual, spread])  # documents, their residuals, their variance
    alone, total = weights @ x, weights.sum(1)
    best, step = np.zeros(n_terms), 1_024
    for at in range(0, n_terms, 256):
        s = slice(at, at + 256)
        sums = np.zeros((3, len(best[s]), n_terms), np.float32)  # of documents with both terms
        for k in range(0, n, step):
            part = x[k : k + step].astype(np.float32)
            for w, into in zip(weights, sums, strict=True):
                into += (part[:, s] * w[k : k + step, None]).T @ part
        cells = [[m, one[s, None] - m, one[None] - m, whole - one[s, None] - one[None] + m] for m, one, whole in zip(sums, alone, total, strict=True)]
        held = [np.maximum(c, 1) for c in cells[0]]
        change = sum(sign * r / h for sign, r, h in zip((1, -1, -1, 1), cells[1], held, strict=True))
        variance = sum(np.maximum(v, 0.01) / h**2 for v, h in zip(cells[2], held, strict=True))
        best[s] = np.where(np.min(cells[0], 0) >= PAIR_DOCS, change**2 / variance, 0).max(1, initial=0)
    found = np.argsort(-best, kind="stable")
    return found[best[found] >= PAIR_GAIN]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> FactorizationMachine:
    """Fit on the documents of at most ``max_train`` labelled ids, picked evenly by a hash of the id.

    At most ``max_terms`` terms, those that go with the label most, become inputs (a documented bound of the model, like the number
    of hash buckets). The taught texts are staged once; four passes read that table.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # max_train rows of two numbers
    taught, path = staged_at(taught.withColumn("t", _term_column("text")).select("y", "t"))
    try:
        return _learned(taught, max_terms)
    finally:
        discard(path)


def _learned(taught: DataFrame, max_terms: int) -> FactorizationMachine:
    """Fit on rows of (y int, t: the buckets of a text)."""
    n, n1 = taught.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    place = np.full(BUCKETS, -1, np.int32)
    if not n1 or n1 == n:
        rate = (n1 + 0.5) / (n + 10)
        return FactorizationMachine(float(np.log(rate / (1 - rate))), place, np.zeros(1), np.zeros((1, FACTORS)))
    counts = taught.select("y", F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("c"), F.sum("y").alias("c1")).filter(F.col("c") >= MIN_DOCS)
    c, c1 = F.col("c"), F.col("c1")
    cells = [(c1, c * n1 / n), (c - c1, c * (n - n1) / n), (n1 - c1, (n - c) * n1 / n), (n - c - n1 + c1, (n - c) * (n - n1) / n)]  # seen, expected
    gain = sum((F.when(o > 0, 2 * o * F.ln(o / F.greatest(e, F.lit(1e-9)))).otherwise(0.0) for o, e in cells), F.lit(0.0))
    odds = F.ln((c1 + 0.5) / (c - c1 + 0.5) * ((n - n1 + 0.5) / (n1 + 0.5)))
    counts = checkpointed(counts.withColumns({"gain": gain, "telling": (gain >= MIN_GAIN) & (F.abs(odds) >= float(np.log(MIN_ODDS)))}))
    terms = [r["t"] for r in counts.filter("telling").orderBy(F.desc("gain"), "t").limit(max_terms).select("t").collect()]
    apart = F.least(c, n - c)
    often = [r["t"] for r in counts.filter(apart >= 2 * PAIR_DOCS).orderBy(F.desc(apart), "t").limit(PAIR_TERMS).select("t").collect()]
    pool = list(dict.fromkeys([*terms, *often]))
    place[pool] = np.arange(len(pool))
    got = taught.select("y", _placed("t", place).alias("x")).toArrow()  # max_train rows of pool terms
    y = got.column("y").to_numpy().astype(float)
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in got.column("x").chunks])
    cols = np.concatenate([x.flatten().to_numpy() for x in got.column("x").chunks])
    del got
    ends = np.cumsum(sizes)[:-1]

    def fitted(inputs: list[int]) -> tuple[FactorizationMachine, list[np.ndarray]]:
        at = np.full(len(pool) + 1, -1, np.int32)
        at[inputs] = np.arange(len(inputs))
        rows = [np.sort(r[r >= 0]) for part in np.split(cols, ends) for r in (at[part],)]
        of_input = np.full(BUCKETS, -1, np.int32)
        of_input[[pool[k] for k in inputs]] = np.arange(len(inputs))
        bias, w, v = fit_machine(rows, y, max(1, len(inputs)))
        return FactorizationMachine(bias, of_input, w, v), rows

    machine, rows = fitted([*range(len(terms))])
    scores = np.array([machine.of_inputs(r) for r in rows])
    del rows
    looked = np.unique(np.concatenate([np.arange(min(len(terms), PAIR_TERMS // 4)), place[often[: 3 * PAIR_TERMS // 4]]]).astype(np.int64))
    # the rarer label in full, up to half of the rows looked at, and the rows of the other one evenly
    rare = np.flatnonzero(y == (2 * n1 < n))[: PAIR_ROWS // 2]
    rest = np.flatnonzero(y != (2 * n1 < n))
    some = np.sort(np.concatenate([rare, rest[:: max(1, len(rest) // (PAIR_ROWS - len(rare)))][: PAIR_ROWS - len(rare)]]))
    at = np.full(len(pool) + 1, -1, np.int16)
    at[looked] = np.arange(len(looked))
    row_of = np.full(len(y), -1, np.int16)  # of PAIR_ROWS
    row_of[some] = np.arange(len(some))
    of = np.repeat(row_of, sizes)
    seen = (at[cols] >= 0) & (of >= 0)
    paired = looked[telling_pairs(of[seen], at[cols[seen]], y[some], scores[some], len(looked))] if len(looked) else looked
    paired = paired[paired >= len(terms)][:MAX_PAIRED].tolist()
    return fitted([*range(len(terms)), *paired])[0] if paired else machine


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add each text's probability of being toxic."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS places and the weights of its inputs

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = sent.value
        known = _known(machine.place)
        for batch in batches:
            for texts in slices(batch):
                yield pa.array([machine.of_inputs(known.of(t)) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(score_col, of(F.col(text_col)))
