"""Compact keys that stand for long strings inside iterative joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key128(*columns: Column | str) -> Column:
    """A 128-bit key of the given columns as struct<a:bigint,b:bigint>.

    Ids of a code graph are paths of about a hundred bytes; joins and sorts over
    16 bytes move a fraction of that. At 1e12 distinct ids the chance of any
    collision is about 1e-15. Null columns are skipped by the hash, so callers
    filter null ids first.
    """
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))
