"""Session settings that suit the operators; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split skewed join partitions and coalesce small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "graphloom", **settings: str) -> SparkSession:
    """A session with these settings, where none of them is set already."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
