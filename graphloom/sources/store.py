"""Graph snapshots: Parquet tables under a version, and a pointer that is swapped atomically."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom import schemas

POINTER = "_CURRENT"


class SnapshotStore:
    """A folder of snapshots; readers follow the pointer, so a failed write changes nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, **tables: DataFrame) -> str:
        """Writes a complete snapshot and points to it; missing tables are empty. Returns its version."""
        version = f"v-{uuid.uuid4().hex}"
        for name, schema in schemas.TABLES.items():
            df = tables.get(name)
            have = set(df.columns) if df is not None else set()
            full = self.spark.createDataFrame([], schema) if df is None else df.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" if f.name in have else f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in schema])
            full.write.parquet(f"{self.folder}/{version}/{name}.parquet")
        fresh = self._path(f"{POINTER}.{version}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        pointer = self._path(POINTER)
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(POINTER).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, pointer, overwrite)
        return version

    def current(self) -> str | None:
        """The version the pointer names, or None in an empty store."""
        pointer = self._path(POINTER)
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        """A table of the current snapshot with its fixed schema; empty in an empty store."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.folder}/{version}/{name}.parquet")

    def register(self) -> None:
        """Temporary views of all tables, for SQL."""
        for name in schemas.TABLES:
            self.read(name).createOrReplaceTempView(name)
