"""Fitted models as folders of tables, and single rows and values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .session import shared_folder


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"


def saved(tables: dict[str, DataFrame], folder: str) -> str:
    """Write the tables of a model, and last a table of their names: a snapshot without it is not whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_tables")
    return folder


def loaded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in spark.read.parquet(f"{folder}/_tables").collect()}  # a few names


def one(rows: DataFrame) -> Row | None:
    """The first row, or nothing."""
    return rows.first()


def required(rows: DataFrame) -> DataFrame:
    """The rows, if there is exactly one; an error as they are read otherwise."""
    n = rows.limit(2).agg(F.count("*").alias("n"))
    checked = n.select(F.assert_true(F.col("n") == 1, F.lit("exactly one row is required")).alias("ok"))
    return rows.crossJoin(F.broadcast(checked)).drop("ok")  # one row


def scalar(rows: DataFrame):
    """The single value of a one-row, one-column frame; null without rows."""
    row = rows.first()
    return None if row is None else row[0]
