"""Packing of token streams into training sequences of several lengths.

1. Route: a document of n ids (with the one that ends it) gives its full windows of the longest size as they are; the rest goes to the
   smallest tier of window sizes that holds it whole.
2. Pack each tier, longest first. What opens a window is the longest rest of that tier; its gap is filled from the shorter tiers, then
   from its own, each time by the longest rest that fits. If none fits, one rest is cut to the size of the gap, so every window is
   full and at most one document is cut by its border.
3. What is open when a task's rows end, less than a window of each tier, is cut into powers of two, so that no sequence is padded.
4. Step groups: the sequences of some ``STEP_TOKENS`` ids make up a step. Longest first, each goes to the lightest open group.

Every task packs its own rows: nothing is shuffled, and the windows left open between batches are all that a task remembers. Tiers are
powers of two, so their sequences need no padding.

Odd cases: null and empty texts are documents of the ending id alone; rows with the same id are documents of their own; an empty table
gives no pieces; texts may be of any length; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, BpeTokenizer, _refuse_unknown, byte_alphabet
from .common import ship_package, slices

#: Window sizes, ascending powers of two, the id that ends a document, and ids of a step group.
TIERS, END, STEP_TOKENS = (128, 256, 512, 1024), 0, 1 << 16


class Encoder:
    """Ids as the ``tokenizers`` file gives them. Its ids have to be the ranks of its merges, as is usual; then a compiled rank encoder
    gives the same ones. Runs of white space too long for its pattern engine are left to our own encoder."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        _refuse_unknown(parsed)
        self.spec, self.own = spec, None
        vocab, alphabet = parsed["model"]["vocab"], byte_alphabet()
        special = {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError("ids have to follow the order of merges")
        self.rank_encoder = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.rank_encoder.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            self.own = self.own or BpeTokenizer(self.spec)
            return np.frombuffer(self.own.encode_bytes(text), "<u4")


class Packer:
    """Packs rests of documents, ``(doc, start, length)`` with a length under the longest window, into full windows.

    Rests wait by length; a bit of ``waiting`` says which lengths there are, so the longest one that fits is found at once.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.rests: list[list[tuple[int, int]]] = [[] for _ in range(tiers[-1] + 1)]
        self.waiting = 0
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # windows not yet full, by tier

    def add(self, doc: int, start: int, length: int) -> None:
        self.rests[length].append((doc, start))
        self.waiting |= 1 << length

    def _take(self, length: int) -> tuple[int, int]:
        out = self.rests[length].pop()
        if not self.rests[length]:
            self.waiting &= ~(1 << length)
        return out

    def _longest(self, low: int, high: int) -> int:
        """The longest length from low + 1 to high that waits; 0 if none."""
        fits = (self.waiting & ((1 << (high + 1)) - 1)) >> (low + 1)
        return low + fits.bit_length() if fits else 0

    def _shortest(self, low: int, high: int) -> int:
        """The shortest length from low + 1 to high that waits, of which there is one."""
        fits = (self.waiting & ((1 << (high + 1)) - 1)) >> (low + 1)
        return low + (fits & -fits).bit_length()

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, until rests run out; the last of each tier may stay open."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while True:
                window = self.open.pop(size, [])
                if not window:
                    length = self._longest(below, size)
                    if not length:
                        break
                    window = [(*self._take(length), length)]
                gap = size - sum(length for _, _, length in window)
                while gap and self.waiting & ((1 << (size + 1)) - 1):
                    length = self._longest(0, min(gap, below or size)) or self._longest(0, gap)
                    if length:
                        window.append((*self._take(length), length))
                        gap -= length
                        continue
                    over = self._shortest(gap, size)
                    doc, start = self._take(over)
                    window.append((doc, start, gap))
                    self.add(doc, start + gap, over - gap)
                    gap = 0
                if gap:
                    self.open[size] = window
                    break
                yield window

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What is open, in sequences of powers of two."""
        for size in sorted(self.open, reverse=True):
            window = self.open.pop(size)
            left = sum(length for _, _, length in window)
            while left:
                want, out = 1 << (left.bit_length() - 1), []
                left -= want
                while want:
                    doc, start, length = window.pop(0)
                    now = min(want, length)
                    out.append((doc, start, now))
                    want -= now
                    if now < length:
                        window.insert(0, (doc, start + now, length - now))
                yield out


class Steps:
    """Deals sequences to step groups of some ``tokens`` ids: the longest first, each to the lightest group. Too few for a group of
    their own join those of the deal before."""

    def __init__(self, tokens: int):
        self.tokens, self.made, self.weights = tokens, 0, []

    def deal(self, sizes: list[int]) -> list[int]:
        groups, out = round(sum(sizes) / self.tokens), [0] * len(sizes)
        if groups or not self.weights:
            self.weights = [(0, self.made + g) for g in range(max(1, groups))]
            self.made += max(1, groups)
        for s in sorted(range(len(sizes)), key=lambda s: -sizes[s]):
            weight, g = self.weights[0]
            out[s] = g
            heapq.heapreplace(self.weights, (weight + sizes[s], g))
        return out


_loaded: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(spec)
    return _loaded[key]


class _Task:
    """The sequences of one task. ``docs`` holds the documents that have pieces in open windows."""

    def __init__(self, encoder: Encoder, kind: pa.DataType, part: int, tiers: tuple[int, ...], end: int, step_tokens: int, names: list[str]):
        self.encoder, self.kind, self.base, self.tiers, self.end, self.names = encoder, kind, part << 33, tiers, end, names
        self.packer, self.steps, self.made = Packer(tiers), Steps(step_tokens), 0
        self.docs: dict[int, tuple[object, np.ndarray]] = {}
        self.seen = 0

    def add(self, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        top, full = self.tiers[-1], []
        for key, text in zip(keys, texts.to_pylist(), strict=True):
            ids = np.append(self.encoder.encode(text or ""), np.uint32(self.end)).astype("<u4")
            doc, self.seen = self.seen, self.seen + 1
            self.docs[doc] = key, ids
            whole = len(ids) - len(ids) % top
            full += [[(doc, at, top)] for at in range(0, whole, top)]
            if whole < len(ids):
                self.packer.add(doc, whole, len(ids) - whole)
        return self._given(full + list(self.packer.pack()))

    def finish(self) -> pa.RecordBatch:
        return self._given(list(self.packer.rest()))

    def _given(self, sequences: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        groups = self.steps.deal([sum(length for _, _, length in s) for s in sequences]) if sequences else []
        keys, rows, parts = [], [], []
        for s, group in zip(sequences, groups, strict=True):
            offset, size = 0, sum(length for _, _, length in s)
            for doc, start, length in s:
                key, ids = self.docs[doc]
                piece = ids[start : start + length]
                keys.append(key)
                rows.append((start, length, crc32(piece), len(ids), self.base + self.made, offset, size, self.base + group))
                parts.append(piece)
                offset += length
            self.made += 1
        held = {doc for window in self.packer.open.values() for doc, _, _ in window}
        self.docs = {doc: self.docs[doc] for doc in held}
        columns = [pa.array([k.as_py() for k in keys], self.kind), *(pa.array(c) for c in np.array(rows, np.int64).reshape(-1, 8).T)]
        if self.names[-1] == "ids":
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, "<u4")]).astype(np.int32))))
        return pa.record_batch(columns, names=self.names)


def pack(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end: int = END, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group, ids).

    ``window`` is the length of the piece's sequence, which needs no padding. ``tokenizer_json``: the content of a tokenizer file.
    Ids of sequences and groups are made of the task's number: write the result before it is shuffled twice."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    ship_package(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: a few MB
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        for batch in batches:
            if task is None:
                task = _Task(_encoder(spec.value), batch.schema.field(0).type, TaskContext.get().partitionId(), tiers, end, step_tokens, names)
            at = 0
            for part in slices(batch.column(1)):
                yield task.add(batch.column(0).slice(at, len(part)), part)
                at += len(part)
        if task is not None:
            yield task.finish()

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group", *(["ids"] if with_ids else [])]
    kinds = [rows.schema["key"].dataType.simpleString(), *["long"] * 8, *(["array<int>"] if with_ids else [])]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))).withColumnRenamed("key", id_col)
