"""Dense 0- or 1-based positions in a global order, without a one-task window.

``row_number() over (order by k)`` has no partition key, so Spark runs it in
a single task. Here the rows are range-partitioned and sorted by the key, get
a number within their partition, and are written once; the partitions' counts
(one row each) give the offsets. The input is computed once, nulls come first,
and only the offsets are summed in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.session import ensure_checkpoint_dir, write_table


def with_position(df: DataFrame, order_cols: list[str], name: str = "pos", start: int = 0,
                  ranges: int | None = None) -> DataFrame:
    """Add ``name`` = ``start`` + rank of the row in ``order_cols`` order (nulls first).

    All columns of ``df`` are written along, so number a projection and join
    back where rows are wide. Ties are numbered in an arbitrary order: add a
    tiebreak column where that matters.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    # the low 33 bits of the id count the rows of a partition, the rest is its number
    placed = write_table(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_id", F.monotonically_increasing_id()), "positions")
    placed = (placed.withColumn("_range", F.shiftright("_id", 33))
              .withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return (placed.join(base, "_range").withColumn(name, F.col("_base") + F.col("_row") + F.lit(start))
            .drop("_range", "_row", "_base"))
