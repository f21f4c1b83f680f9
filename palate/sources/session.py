"""The session: lineage cuts and written tables in the folder that all executors share, and this package on their Python path."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a folder of our own, in local mode only: there driver and executors are
    one process. On a cluster a folder of the driver's machine would lose data, so it is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="palate-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


_written: dict[str, SparkSession] = {}


def staged_at(df: DataFrame, options: dict | None = None) -> tuple[DataFrame, str]:
    """Write the frame once as Parquet in the shared folder and read it back: columns stay prunable and a lost executor costs nothing.

    Also gives the path, for ``discard`` once nothing reads it any more; what is left goes at the end of the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    return staged_at(df)[0]


def discard(path: str) -> None:
    """Delete a staged table."""
    spark = _written.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                discard(path)
        except Exception:  # the application has ended; whoever owns the folder clears it
            return


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, so that they need no install of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top, folder = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="palate-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file from here as they start
    target = Path(folder) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
