"""Helpers shared by the operators of this subpackage.

Operators take a DataFrame and column names, read only the named columns (so
extra columns never clash) and return a table with a stated set of columns.
Whatever is needed twice is written once to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import write_table

#: White space of all operators here: space and U+0009 to U+000D.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    fixes generated ids, and survives the loss of executors."""
    return write_table(df, f"llm-{name}")


#: Rows in a batch that a Python task gets at once (Spark also bounds its bytes).
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to hand rows to Python in small batches:
    texts are long, and a task holds a batch beside what it builds from it."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """array<string>: the white-space separated words of ``text``."""
    return F.filter(F.split(text, f"[{WS_CLASS}]+", -1), lambda w: w != F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable holds it,
    so that the optimizer can't copy the expression into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hex_digest(c: Column) -> Column:
    """Lower-case hex SHA-256 of a string (as UTF-8) or binary column."""
    return F.sha2(c.cast("binary"), 256)


def scale_partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, for explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def content_key(id_col: str, text_col: str) -> Column:
    """Hash of a row's id and text; rows that share both are interchangeable."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from the
    columns of ``docs``, in any case."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def one_row_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` named by ``chosen`` (id, key, n), all columns as they
    are, one for each name; n is how many rows share the id and the key. Where n
    is above one the rows are alike in id and text, and any one is taken."""
    key, named_id, named_key, n = free_names(docs, "key", "named_id", "named_key", "n")
    keyed = docs.withColumn(key, content_key(id_col, text_col))
    named = chosen.select(F.col("id").alias(named_id), F.col("key").alias(named_key), F.col("n").alias(n))
    same = (F.col(key) == F.col(named_key)) & F.col(id_col).eqNullSafe(F.col(named_id))
    single = keyed.join(named.filter(F.col(n) == 1), same, "left_semi")
    if named.filter(F.col(n) > 1).isEmpty():
        return single.drop(key)
    repeated = keyed.join(named.filter(F.col(n) > 1), same, "left_semi").dropDuplicates([id_col, key])
    return single.unionByName(repeated).drop(key)
