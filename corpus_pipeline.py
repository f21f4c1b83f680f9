"""From raw documents to training tokens: drop toxic texts, shared lines and near-duplicates, mix to target weights, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and the next stage reads it as its docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm import bpe, line_dedup, mixing, simhash, toxicity
from palate.llm.common import discard, read_table, staged_at
from palate.llm.queries import MIX_TARGETS, labelled_domains, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine takes for toxic go; it learns from the labelled documents among these."""
    machine = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), machine, score_col="__toxic").filter(F.col("__toxic") < 0.5).drop("__toxic")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the smallest doc_id only; every document stays, if empty."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cut.select("doc_id", F.when(F.col("text").isNotNull(), F.col("kept_text")).alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id: five-word shingles that overlap by 0.8 or more.

    Rows are judged one by one: those that share a doc_id but not a group all stay, if first in theirs; of rows equal in doc_id and
    text one stays; rows without a doc_id come after all others of their group."""
    return simhash.drop_similar(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them. The least rate is 1: none is lost, and the targets are reached by repetition, with as
    many more tokens as that takes, twice as many at most."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs, labelled_domains(spark, sf_dir, docs), MIX_TARGETS, floor=1.0, growth=None)
    copies = F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))
    return mixed.select(*COLUMNS, F.explode(copies).alias("copy")).drop("copy")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and a digest of what they decode to."""
    spec = vocabulary()
    coded = bpe.encode_and_decode(docs.select(*COLUMNS), spec)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The models of the first and fourth stage are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written is deleted once the next one is written; the last table read stays until the end."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, before = stage(spark, docs, sf_dir), path
        if k < len(STAGES) - 1:
            docs, path = staged_at(docs)
            if before is not None:
                discard(before)
    return docs
