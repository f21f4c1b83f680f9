"""Language by compression: the language whose text best helps zstandard to pack a document.

For each language, however many, a raw-content dictionary is filled with a bounded sample of its labelled texts, without the lines that pack
better with another language (quotations, licences). A document, in lower case, is encoded once with each dictionary, in chunks, so
that also a long text keeps asking the dictionary instead of its own beginning; savings in a chunk count up to a share of it, so
that one passage copied from a dictionary does not decide. The language with the fewest bytes is chosen, and the choice is flagged
as rejected when the margin to the next one is narrow.

Odd cases: null text and text without a letter are ``und`` with score 0; without any labelled text all are ``und``; ties go to the
language first in order; texts of any length are read whole; other columns stay (those named as an output are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, ship_package, slices

#: Bounds of what is learned: bytes of a dictionary and of all of them (many languages share these), documents a language to fill it
#: from, and the share of a dictionary that one of them gives at most (its first bytes).
DICT_BYTES, ALL_BYTES, DOCS_PER_LANG, SHARE = 120_000, 24_000_000, 120, 8
#: Rows of the chosen sample that are sent to every executor.
MOST_SENT = 100_000
LEVEL, CHUNK_BYTES, MOST_SAVED = 6, 1_024, 0.12
#: A choice is rejected if the next language needs less than this share more bytes, or less than so many.
NARROW_SHARE, NARROW_BYTES = 0.01, 3

_LETTER = re.compile(r"[^\W\d_]")


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content for each language. Only ids travel to choose the sample, and the chosen ones go to the texts while they
    are few (counted; texts meet them by a shuffle beyond that); of the chosen rows no more bytes are fetched than two dictionaries
    hold. Repeated rows count as one text."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    langs = rows.select("lang").distinct().count()
    each = min(DICT_BYTES, ALL_BYTES // max(1, langs))
    order = Window.partitionBy("lang").orderBy("key", "id", "hash")
    picked = rows.select("lang", "id", "hash", F.xxhash64("id").alias("key"))
    picked = picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= DOCS_PER_LANG)
    picked = picked.groupBy("lang", "id", "hash").agg(F.min("rank").alias("rank"))
    if langs * DOCS_PER_LANG <= MOST_SENT:
        picked = F.broadcast(picked)
    texts = rows.join(picked, ["id", "lang", "hash"]).select("lang", "rank", F.substring(F.encode("text", "UTF-8"), 1, max(1, each // SHARE)).alias("text"))
    texts = texts.groupBy("lang", "rank").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank", "text").rowsBetween(Window.unboundedPreceding, -1))  # DOCS_PER_LANG rows a language
    texts = texts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < 2 * each).select("lang", "rank", "text")
    found: dict[str, list[str]] = {}
    for lang, _, text in sorted((r["lang"], r["rank"], bytes(r["text"])) for r in texts.collect()):  # three times ALL_BYTES at most
        found.setdefault(lang, []).append(text.decode("utf-8", "ignore").lower())
    return _own_lines(found, each)


def _filled(texts: list[str], size: int) -> bytes:
    return "\n".join(texts).encode()[:size]


def _own_lines(found: dict[str, list[str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries of the lines that no other language packs better; either half of the texts is held against the other half."""
    langs, kept = sorted(found), {lang: [] for lang in found}
    for half in (0, 1):
        packers = _make({lang: _filled(found[lang][1 - half :: 2], size) or b" " for lang in langs})
        for k, lang in enumerate(langs):
            for text in found[lang][half::2]:
                lines = [x for x in text.split("\n") if len(x) < 40 or (sizes := [len(p.compress(x.encode())) for p in packers])[k] <= min(sizes)]
                if lines:
                    kept[lang].append("\n".join(lines))
    return {lang: _filled(kept[lang] or found[lang], size) for lang in langs}


def _make(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


_packers: dict[tuple, list[zstandard.ZstdCompressor]] = {}


def _compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    key = tuple(map(hash, dictionaries.values()))
    if key not in _packers:
        _packers.clear()
        _packers[key] = _make(dictionaries)
    return _packers[key]


def packed_sizes(text: str, packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that the text takes with each dictionary; a chunk counts as no less than its middle size less ``MOST_SAVED``."""
    raw = text.lower().encode()
    sizes = np.array([[len(p.compress(raw[k : k + CHUNK_BYTES])) for p in packers] for k in range(0, len(raw), CHUNK_BYTES)], float)
    return np.maximum(sizes, (1 - MOST_SAVED) * np.median(sizes, axis=1, keepdims=True)).sum(0)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected."""
    ship_package(docs.sparkSession)
    langs = list(dictionaries)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # ALL_BYTES at most

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packers = _compressors(sent.value)
        for texts in (part for batch in batches for part in slices(batch)):
            names, scores, rejected = [], [], []
            for text in texts.to_pylist():
                if not text or not packers or not _LETTER.search(text):
                    names.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                sizes = packed_sizes(text, packers)
                k = int(sizes.argmin())
                margin = float(np.partition(sizes, 1)[1] - sizes[k]) if len(sizes) > 1 else np.inf
                names.append(langs[k])
                scores.append(float(1 / np.exp2(-(sizes - sizes[k])).sum()))  # as if a byte more halved the odds
                rejected.append(bool(margin < max(NARROW_BYTES, NARROW_SHARE * sizes[k])))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    made: Column = judge(F.col(text_col))
    kept = docs.drop(*(c for c in ("lang_pred", "score", "rejected") if c != text_col))
    name, = fresh(kept.columns, "made")
    return kept.withColumn(name, made).select("*", f"{name}.*").drop(name)
