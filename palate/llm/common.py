"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import checkpointed, discard, shared_folder, ship_package, staged, staged_at

__all__ = ["ascii_lower", "checkpointed", "discard", "fresh", "read_table", "shared_folder", "ship_package", "slices", "staged", "staged_at", "words"]

#: Bytes of text that a worker turns into Python strings at a time; one longer text is a slice by itself.
SLICE_BYTES = 4 << 20

#: The six ASCII white-space characters, as a class for Java and Python patterns and as a plain string.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """An Arrow batch of texts cut by bytes: batches are cut by Spark (``spark.sql.execution.arrow.maxBytesPerBatch``), but Python
    strings take several times their bytes."""
    if not len(texts):
        yield texts
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names for internal use that clash with none of those taken (which Spark compares without regard to case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the faster built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space, as an array (null or blank text: empty)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))
