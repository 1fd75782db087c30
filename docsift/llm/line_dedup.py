"""Removal of repeated passages by overlapping three-line windows.

Every three consecutive lines with a word are a window, known by two 64-bit
hashes. The first occurrence of a window, by document and line, stays; every
line that a later occurrence covers is removed. So the first occurrence of any
line always stays: a line under a later window also stands in an earlier one.
Counts are pre-aggregated before the shuffle, and the join that finds the later
occurrences is split where one window is very frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import WS_CLASS, let, materialize, text_of

WINDOW_LINES = 3


def windows(text: Column, n: int = WINDOW_LINES) -> Column:
    """array<struct<first, last, h1, h2>>: the windows of ``n`` lines that have a
    word; first and last are line numbers, so blank lines between are inside."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(f"[^{WS_CLASS}]"))

    def window(found: Column, i: Column) -> Column:
        each = [F.get(found, i + k) for k in range(n)]
        hashes = [F.xxhash64(F.lit(salt), *[e["x"] for e in each]) for salt in (1, 2)]
        return F.struct(each[0]["i"].alias("first"), each[-1]["i"].alias("last"), hashes[0].alias("h1"), hashes[1].alias("h2"))

    return let(lines, lambda found: F.when(F.size(found) >= n, F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: window(found, i))))


def without(text: Column, covered: Column) -> Column:
    """``text`` without the line ranges ``covered`` (sorted, disjoint)."""
    def rest(lines: Column, m: Column) -> Column:
        def between(j: Column) -> Column:
            start = F.coalesce(F.get(m, j - 1)["last"] + 1, F.lit(0))
            end = F.coalesce(F.get(m, j)["first"], F.size(lines))
            return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(m)), between)), "\n")

    return F.when(covered.isNull(), text).otherwise(let(F.split(text, "\n", -1), lambda x: rest(x, covered)))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW_LINES) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``text`` (what is left), one row
    per input row.

    Documents are in the order of their ids, null ids last; rows with the same
    id in an arbitrary order, so that of repeated rows one keeps its text. A
    null text counts as empty, which has one line and no window. Fewer than
    ``n`` lines with a word are left alone. A window that overlaps its own
    first occurrence counts as later. Other columns are ignored; an empty table
    gives an empty table.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), "lines-docs")
    found = materialize(numbered.select("row", "doc_id", F.explode(windows(F.col("text"), n)).alias("w")).select("row", "doc_id", "w.*"), "lines-windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("first"))
    firsts = materialize(found.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                         .select("h1", "h2", F.col("at.row").alias("row0"), F.col("at.first").alias("first0")), "lines-repeated")
    later = found.join(firsts, ["h1", "h2"]).filter("row <> row0 or first <> first0").select("row", "first", "last")
    # merge what a document's later windows cover
    order = Window.partitionBy("row").orderBy("first")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (F.coalesce(before, F.lit(-2)) + 1 < F.col("first")).cast("int")).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("row", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    covered = materialize(merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("covered"),
                                                    F.sum(F.col("last") - F.col("first") + 1).alias("n_removed")), "lines-covered")
    out = numbered.join(covered, "row", "left")
    return out.select("doc_id", (F.length(F.regexp_replace("text", "[^\n]+", "")) + 1).cast("long").alias("n_lines"),
                      F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), without(F.col("text"), F.col("covered")).alias("text"))
