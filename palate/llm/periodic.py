"""Maximal runs of repeated words, by power-of-two naming.

A run is a stretch of words whose smallest period q goes at least twice into it and which no neighbouring word extends keeping that
period. For each period q, every run of it holds two grid points q apart, so it is enough to extend from the points of a grid:

1. Naming (Karp, Miller, Rosenberg): level k names every stretch of 2^k words, equal stretches alike; a name of level k + 1 is made of
   two names of level k. All texts of a batch are named together, each with names of its own. A stretch that occurs once in its text
   gets a name that nothing equals and is looked at no more, so in plain prose few are left after two levels.
2. Candidates (i, q): the grid for q has a point in every ``max(q, shortest - q)`` words. A run reaches so far to one side of a point
   that a stretch of half that length is equal; its name tells, which leaves few candidates.
3. Extension: how far the words on either side stay equal is found by descending name levels, for all candidates at once. No word is
   hashed and no suffix sorted: names are equal exactly if the words are.
4. Of equal stretches the smallest period is the run's: a longer period of the same stretch is a multiple of it.

All steps are NumPy over Arrow batches inside tasks; a document stays in its task and nothing is shuffled. Time is some n log n grid
points for n words of a text; they are made and cut down in blocks of ``BLOCK``, so memory is linear in the text.

Odd cases: null, empty and wordless texts have no runs and collapse to the empty text; texts may be of any length; other columns stay
as they are (one named as an output is replaced); rows with the same id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_package, slices

#: Words that a run has at least.
SHORTEST = 12
#: Grid points that are looked at together.
BLOCK = 1 << 21


def _names(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Names by level; ``words`` are told apart between texts already, ``ends`` is the end of the text around each word. A stretch that
    occurs once, or that its text ends before, has the name ~i, which no other has."""
    n = len(words)
    at = np.arange(n, dtype=np.int64)
    out: list[np.ndarray] = []
    keys, width, now = words, 1, None
    while len(at):
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = times[inverse] > 1
        now = ~np.arange(n, dtype=np.int64)
        now[at[twice]] = inverse[twice]
        out.append(now)
        at = at[twice]
        at = at[at + 2 * width <= ends[at]]
        other = now[at + width]
        at, other = at[other >= 0], other[other >= 0]
        keys, width = now[at] * n + other, 2 * width
    return out or [~np.arange(n, dtype=np.int64)]


def _forward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from i and from j on (i < j) are equal, before ``limit``, the end of their text. Each level is taken once at most:
    two equal stretches twice as long would have had a name of the level above."""
    at, far = i.copy(), j.copy()
    for k in range(len(names) - 1, -1, -1):
        name = names[k]
        live = np.flatnonzero(far < limit)
        same = live[name[at[live]] == name[far[live]]]
        at[same] += 1 << k
        far[same] += 1 << k
    return at - i


def _backward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words before i and before j (i < j) are equal, from ``start``, the start of their text."""
    at, far = i.copy(), j.copy()
    for k in range(len(names) - 1, -1, -1):
        name = names[k]
        live = np.flatnonzero(at - (1 << k) >= start)
        same = live[name[at[live] - (1 << k)] == name[far[live] - (1 << k)]]
        at[same] -= 1 << k
        far[same] -= 1 << k
    return i - at


def _grid(starts: np.ndarray, sizes: np.ndarray, shortest: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grid points (i, q, text) of all texts, some ``block`` of them at a time."""
    long = np.flatnonzero(sizes >= shortest)
    periods = sizes[long] // 2
    text = np.repeat(long, periods)
    q = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    step = np.maximum(q, shortest - q)
    points = -(-(sizes[text] - q) // step)
    ends, at = np.cumsum(points), 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        own = points[at:stop]
        k = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        deal = lambda x: np.repeat(x[at:stop], own)  # noqa: B023, E731
        yield starts[deal(text)] + k * deal(step), deal(q), deal(text)
        at = stop


def runs_of(words: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST, block: int = BLOCK) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of all runs of at least ``shortest`` words in texts of ``sizes`` words each, one
    after the other in ``words`` (numbers; equal words alike)."""
    sizes = np.asarray(sizes, np.int64)
    starts, n = np.cumsum(sizes) - sizes, len(words)
    if not n:
        return np.empty((0, 4), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = (starts + sizes)[text]
    _, plain = np.unique(words, return_inverse=True)
    names = _names(text * n + plain, ends)
    found = np.empty((0, 4), np.int64)
    for i, q, t in _grid(starts, sizes, shortest, block):
        half = (np.maximum(q, shortest - q) + 1) // 2
        level = np.log2(half).astype(np.int64)
        near = np.zeros(len(i), bool)
        for k in np.unique(level).tolist():
            if k >= len(names):
                continue  # no stretch of that length occurs twice
            mine = np.flatnonzero(level == k)
            a, name, w = i[mine], names[k], 1 << k
            b = a + q[mine]
            equal = name[a] == name[b]
            back = a - w >= starts[t[mine]]
            equal[back] |= name[a[back] - w] == name[b[back] - w]
            near[mine] = equal
        i, q, t = i[near], q[near], t[near]
        begin, end = starts[t], starts[t] + sizes[t]
        right, left = _forward(names, i, i + q, end), _backward(names, i, i + q, begin)
        length = left + right + q
        is_run = length >= np.maximum(2 * q, shortest)
        found = np.concatenate([found, np.stack([t, i - left - begin, length, q], 1)[is_run]])
        # of each stretch the smallest period
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.append(True, (found[1:, :3] != found[:-1, :3]).any(1))] if len(found) else found
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of a text's ``n`` words stay if each run (start, length, period) keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def _judged(texts: list[str | None], shortest: int) -> tuple[np.ndarray, list[str]]:
    """The runs of all texts and each text without its repetitions."""
    lists = [(t or "").encode().split() for t in texts]  # bytes: only ASCII white space
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for ws in lists for w in ws), np.int64)
    runs = runs_of(numbers, np.array([len(ws) for ws in lists], np.int64), shortest)
    bounds = np.searchsorted(runs[:, 0], np.arange(len(lists) + 1))
    out = []
    for k, ws in enumerate(lists):
        own = runs[bounds[k] : bounds[k + 1], 1:]
        out.append(b" ".join(ws if not len(own) else [ws[x] for x in np.flatnonzero(kept_words(own, len(ws))).tolist()]).decode())
    return runs, out


def collapse_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", shortest: int = SHORTEST) -> DataFrame:
    """Add the runs of each whole text, by start and then period, and the text without repetitions: the words that stay, joined by spaces."""
    ship_package(docs.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf("struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                runs, texts = _judged(part.to_pylist(), shortest)
                ends = np.searchsorted(runs[:, 0], np.arange(len(part) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(kind))
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(texts, pa.string())], ["runs", "collapsed"])

    made, text = fresh([*docs.columns, runs_col, collapsed_col], "made", "text")
    base = docs.withColumn(text, F.col(text_col))
    base = base.drop(*(c for c in (runs_col, collapsed_col) if c in base.columns))
    return base.withColumn(made, judged(F.col(text))).withColumns({runs_col: F.col(f"{made}.runs"), collapsed_col: F.col(f"{made}.collapsed")}).drop(made, text)
