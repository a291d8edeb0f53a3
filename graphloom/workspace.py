"""Shared scratch space: tables written to cut the lineage of iterative jobs.

The folder is the one the session names in ``spark.checkpoint.dir``, which all
executors share. Only where that is unset, and only on a local master, a
temporary folder is used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the most rows that a join sends whole to every executor.
BROADCAST_ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def by_size(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """One side of a join, to be sent whole or never, as its number of rows tells.

    Left alone, Spark goes by bytes on disk, of which ids that follow one another take a
    small part of what they take in the driver's memory.
    """
    return F.broadcast(df) if rows <= most else df.hint("merge")


class Scratch:
    """Tables of one job under the shared folder.

    ``save`` writes a DataFrame and returns one that reads it, so that a lost
    executor costs a re-read and not a recomputation; ``drop`` deletes a saved
    table once nothing reads it any more. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None) if df is not None else None
        if path:
            self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; the folder's owner clears it
            pass
