"""Rows by name keep every column, whatever it is called."""

from pyspark.sql import functions as F

from docsift.llm.common import content_key, free_names, one_row_each


def test_columns_with_clashing_names_stay(spark):
    rows = [(1, "a", "x", 10), (2, "b", "y", 20), (2, "b", "y", 20), (None, None, "z", 30), (3, "c", "w", 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key string, __N int")
    assert free_names(docs, "key", "n") == ["___key", "___n"]
    counts = docs.groupBy(F.col("doc_id").alias("id"), content_key("doc_id", "text").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    got = one_row_each(docs, counts.filter("id is null or id < 3"), "doc_id", "text")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted({r for r in rows if r[0] != 3}, key=repr)
