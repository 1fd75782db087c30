"""Keyed joins between result tables.

No join here forces a broadcast: with AQE on, Spark turns a shuffle join
into a broadcast join only after measuring the built side at runtime against
``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond that size the
sort-merge plan stays and skewed partitions are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must shuffle: a table that grows with the input, and
    that Spark may take for small enough to be sent through the driver (few bytes on
    disk, or rows that a generator multiplies)."""
    return df.hint("merge")


def unmatched(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right`` (NOT EXISTS)."""
    keys = [key] if isinstance(key, str) else list(key)
    return left.join(right.select(*keys), keys, "left_anti")


def side_by_side(left: DataFrame, right: DataFrame, key: str, left_flag: str, right_flag: str) -> DataFrame:
    """Full outer join on ``key`` with presence flags for each side."""
    l2 = left.withColumn(left_flag, F.lit(True))
    r2 = right.withColumn(right_flag, F.lit(True))
    out = l2.join(r2, key, "full_outer")
    return out.fillna(False, subset=[left_flag, right_flag])
