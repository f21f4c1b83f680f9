"""Scans: statements with parameters over frames, slices by user, ordered batches for consumers that go on where they stopped."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import global_rank


def statement(spark: SparkSession, sql: str, parameters: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of a statement. Frames stand in it as ``{name}``, values as ``:name``; values are never pasted into the text, so none
    can change it, and filters on them reach the frames' scans."""
    return spark.sql(sql, args=parameters or {}, **tables)


def user_slice(entries: DataFrame, low: Any = None, high: Any = None, least_scored: int = 0) -> DataFrame:
    """Entries of the users from ``low`` to ``high``, both included; null: no bound. With ``least_scored`` only of those who gave as many
    scores or more."""
    out = entries
    if low is not None:
        out = out.filter(F.col("user_id") >= F.lit(low))
    if high is not None:
        out = out.filter(F.col("user_id") <= F.lit(high))
    if least_scored <= 0:
        return out
    enough = out.filter("score > 0").groupBy("user_id").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least_scored)
    return out.join(enough.select("user_id"), "user_id", "left_semi")


def batched(rows: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """Add batch: numbers from 0 of the batches of ``size`` rows in an order, which should leave no ties.

    The place of a row is counted range by range, so no task sees more than its range; a consumer takes the batches it has not done yet.
    """
    if size < 1:
        raise ValueError("a batch holds one row at least")
    return global_rank(rows, *order, name="__place").withColumn("batch", F.floor((F.col("__place") - 1) / size)).drop("__place")


def batches_after(rows: DataFrame, done: int | None) -> DataFrame:
    """Batched rows beyond the last batch that is done; null: all of them."""
    return rows if done is None else rows.filter(F.col("batch") > done)
