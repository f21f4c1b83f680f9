"""Byte-level BPE by dynamic programming over prefixes.

A byte-pair encoding is determined by its neighbouring token pairs: a token sequence is *the* encoding of its bytes exactly if
every token encodes to itself and no two neighbours would have been merged across their border. So each prefix of a piece has one
possible last token. The encoder reads a piece once through an automaton of all tokens, which yields the tokens that end at each
byte; a token is the last one of its prefix if it is compatible with the last token of the prefix it leaves. Back-pointers then
give the ids. Time is linear in the piece for a bounded token length, however long the piece is; no merge loop runs.

Results for the odd cases: null text encodes as the empty text, the empty text gives no ids and decodes to the empty text, texts
may be of any length (their ids must fit one Arrow value), ids that the vocabulary lacks are skipped in decoding, null id arrays
decode to the empty text. Input columns named as an output column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import weakref
from array import array
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship_package, slices

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces with their ids and number of token pairs that a worker remembers, and the longest piece remembered: some 50 MB in
#: all. ``SLICE``: bytes of text encoded at a time. Memory only, results do not depend on them.
PIECE_BYTES, PAIRS, LONGEST_KEPT, SLICE = 28 << 20, 250_000, 200, 1 << 20

_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _refuse_unknown(spec: dict) -> None:
    """Settings of the file that would change ids and that are not built here are refused, not ignored."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("a plain byte-level BPE model is needed")
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only the byte-level pre-tokenizer without normalizer and prefix space is known")
    if any(t.get(flag) for t in spec.get("added_tokens") or [] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("added tokens may not be stripped, normalized or bound to whole words")


class _Pieces(dict):
    """Piece -> its ids as int32 bytes. When half of ``PIECE_BYTES`` is full, it becomes ``older``, and what was there is forgotten;
    pieces still in use are taken back from it, so rare ones do not drive out frequent ones."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.held = encode, {}, 0

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            out = self.encode(piece)
            if len(piece) > LONGEST_KEPT:
                return out
        size = piece.__sizeof__() + len(out) + 65  # of both objects and the place in the table
        if self.held + size > PIECE_BYTES // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        self[piece] = out
        self.held += size
        return out


class _Before(dict):
    """Token -> whether it may stand before the one token that this table is of. -1, no token, may not."""

    __slots__ = ("tokenizer", "token")

    def __init__(self, tokenizer: BpeTokenizer, token: int):
        super().__init__()
        self.tokenizer, self.token = weakref.proxy(tokenizer), token  # the automaton holds this table, and no collector sees into it

    def __missing__(self, before: int) -> bool:
        fits = before >= 0 and self.tokenizer.compatible(before, self.token)
        self.tokenizer.remember_pair()
        self[before] = fits
        return fits


class BpeTokenizer:
    """A byte-level BPE vocabulary read from the JSON of a ``tokenizers`` file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        _refuse_unknown(spec)
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*self.special.items(), *vocab.items()]:
            self.bytes_of[i] = to_bytes(token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made, self.parts = [-1] * size, [None] * size
        for k, (left, right) in enumerate(pairs):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if self.parts[c] is not None or max(self.made[a], self.made[b]) >= k:
                raise ValueError("merges must make each token once, from tokens made before")
            self.rank[a, b], self.made[c], self.parts[c] = k, k, (a, b)
        self.n_pairs, self.befores = 0, []
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self._encodes_to_itself(i):
                key, before = self.bytes_of[i].decode("latin-1"), _Before(self, i)
                self.befores.append(before)
                self.automaton.add_word(key, (len(key) - 1, i, before.__getitem__))
        self.automaton.make_automaton()
        self.size_of = [len(b) for b in self.bytes_of]
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pieces = _Pieces(self._encode_piece)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one border of a token, from its byte to itself, each with the rank of the merge that takes it up."""
        spine, until = [], _NEVER
        while True:
            spine.append((token, until))
            if self.parts[token] is None:
                return spine[::-1]
            token, until = self.parts[token][side], self.made[token]

    def _first_merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The first merge across the border of two neighbours while both are built up by rank, leftmost first; None if there is none."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank.get((x, y), _NEVER)
            if r < x_until and r <= y_until and r != _NEVER:
                return x, y
            if x_until == y_until == _NEVER:
                return None
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _encodes_to_itself(self, token: int) -> bool:
        pair = self.parts[token]
        return len(self.bytes_of[token]) == 1 if pair is None else self._first_merge(*pair) == pair

    def compatible(self, a: int, b: int) -> bool:
        return self._first_merge(a, b) is None

    def remember_pair(self) -> None:
        """Count a pair; past ``PAIRS`` all are forgotten."""
        if self.n_pairs >= PAIRS:
            self.n_pairs = 0
            for before in self.befores:
                before.clear()
        self.n_pairs += 1

    def _encode_piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        last = [-1] * len(piece)  # the last token of each prefix
        done = -1
        for end, (n, token, may_follow) in self.automaton.iter(piece):
            if done == end:
                continue
            if end == n or may_follow(last[end - n - 1]):  # the token starts the piece (n is its length less one), or fits what is before
                last[end], done = token, end
        ids, end, size = [], len(piece) - 1, self.size_of
        while end >= 0:
            token = last[end]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte")
            ids.append(token)
            end -= size[token]
        ids.reverse()
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids as int32 bytes."""
        get = self.pieces.__getitem__
        if not self.cut or not any(s in text for s in self.special):
            return b"".join(map(get, self.find(text)))
        return b"".join(np.int32(self.special[part]).tobytes() if part in self.special else b"".join(map(get, self.find(part))) for part in self.cut(text) if part)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        known = self.bytes_of
        return b"".join([known[i] for i in ids if 0 <= i < len(known)]).decode("utf-8", "replace")


_loaded: dict[str, BpeTokenizer] = {}


def _tokenizer(spec: str) -> BpeTokenizer:
    """One tokenizer a worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = BpeTokenizer(spec)
    return _loaded[key]


def _id_lists(tokenizer: BpeTokenizer, texts: pa.Array) -> pa.Array:
    parts = [tokenizer.encode_bytes(t) if t else b"" for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32()))


def _decoded(tokenizer: BpeTokenizer, lists: pa.Array) -> pa.Array:
    get, size = tokenizer.bytes_of.__getitem__, len(tokenizer.bytes_of)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    if lists.flatten().null_count or len(flat) and (flat.min() < 0 or flat.max() >= size):
        return pa.array([tokenizer.decode([i for i in x or [] if i is not None]) for x in lists.to_pylist()], pa.string())
    return pa.array([b"".join(map(get, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in pairwise(ends.tolist())], pa.string())


def _with(df: DataFrame, tokenizer_json: str, kind: str, work):
    """An Arrow UDF of ``work(tokenizer, batch)``. The vocabulary travels once; what a worker remembers serves its next tasks, too."""
    ship_package(df.sparkSession)
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: a few MB

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            yield from work(tokenizer, batch)

    return run


def encode(df: DataFrame, tokenizer_json: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of each whole text. ``tokenizer_json``: the file's content."""
    ids = _with(df, tokenizer_json, "array<int>", lambda tokenizer, texts: (_id_lists(tokenizer, part) for part in slices(texts, SLICE)))
    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, tokenizer_json: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that each id array stands for; bytes that are not UTF-8 become U+FFFD."""
    text = _with(df, tokenizer_json, "string", lambda tokenizer, lists: iter([_decoded(tokenizer, lists)]))
    return df.withColumn(text_col, text(F.col(ids_col)))


def encode_and_decode(df: DataFrame, tokenizer_json: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the ids of each whole text and what they decode to, in one pass of one worker."""

    def both(tokenizer: BpeTokenizer, texts: pa.Array) -> Iterator[pa.Array]:
        for part in slices(texts, SLICE):
            ids = _id_lists(tokenizer, part)
            yield pa.StructArray.from_arrays([ids, _decoded(tokenizer, ids)], ["ids", "decoded"])

    made, = fresh(df.columns, "made")
    run = _with(df, tokenizer_json, "struct<ids:array<int>,decoded:string>", both)
    kept = df.drop(ids_col, decoded_col) if text_col not in (ids_col, decoded_col) else df
    return kept.withColumn(made, run(F.col(text_col))).withColumns({ids_col: F.col(f"{made}.ids"), decoded_col: F.col(f"{made}.decoded")}).drop(made)
