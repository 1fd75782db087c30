"""Sinks: JSON-lines logs, URL lists, the fingerprint store, reports, datasets.

All writers are distributed (one file per partition) except the summary
report, whose rows are bounded by the number of distinct histogram values.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators import labels as L
from docsift.operators.numbering import with_position


def write_jsonl(df: DataFrame, path: str, rec_col: str | None = None, mode: str = "overwrite") -> None:
    """One JSON object per line. With ``rec_col`` (a VARIANT) the record is
    written as is; otherwise every column, nulls kept as ``null``."""
    if rec_col is not None:
        df.select(F.to_json(F.col(rec_col)).alias("value")).write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_url_list(urls: DataFrame, path: str, order: str = "ord") -> None:
    """One URL per line, part files in list order (range-partitioned, sorted)."""
    n = max(1, urls.sparkSession.sparkContext.defaultParallelism)
    (urls.repartitionByRange(n, order).sortWithinPartitions(order)
     .select("url").write.mode("overwrite").text(path))


def append_store(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add new hashes under ``batch_id=<id>``; replaying a batch rewrites only
    its own partition, so a retried micro-batch is idempotent."""
    out = rows.select("hash", "bits", "file", "ord").withColumn("batch_id", F.lit(batch_id).cast("long"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def summary_lines(parsed: DataFrame) -> DataFrame:
    """The classification summary as ordered markdown lines ``(seq, line)``."""
    spark = parsed.sparkSession
    texts = [F.lit(C.REPORT_HEADING), F.lit(C.REPORT_RULE), F.lit(""), F.lit(C.REPORT_OVERVIEW),
             F.concat(F.lit(C.REPORT_TOTAL), F.col("total_records").cast("string")),
             F.concat(F.lit(C.REPORT_SUCCESSFUL), F.col("successful").cast("string")),
             F.concat(F.lit(C.REPORT_FAILED), F.col("failed").cast("string")),
             F.concat(F.lit(C.REPORT_RATE), F.format_number(F.bround("success_pct", 1), 1), F.lit("%")), F.lit("")]
    ov = L.overview(parsed).select(F.lit(0).alias("sec"), F.lit(0).alias("rank"), F.inline(F.array(
        *[F.struct(F.lit(i).alias("sub"), t.alias("line")) for i, t in enumerate(texts)])))
    titles = C.REPORT_TITLES
    sec = F.lit(None).cast("int")
    for i, d in enumerate(titles):
        sec = F.when(F.col("dimension") == d, F.lit(i + 1)).otherwise(sec)
    hist = L.histograms(parsed).select(
        sec.alias("sec"), "rank", F.lit(0).alias("sub"),
        F.concat(F.lit("- "), "value", F.lit(": "), F.col("n").cast("string"), F.lit(" ("),
                 F.regexp_replace(F.format_number(F.bround("pct", 1), 1), ",", ""), F.lit("%)")).alias("line"))
    heads = spark.createDataFrame([(i + 1, 0, 0, t) for i, t in enumerate(titles.values())] +
                                  [(i + 1, 2**31 - 1, 0, "") for i in range(len(titles))],
                                  "sec int, rank int, sub int, line string")
    lines = ov.unionByName(hist).unionByName(heads)
    return with_position(lines, ["sec", "rank", "sub"], "seq", start=1).select("seq", "line")


def write_summary(parsed: DataFrame, path: str) -> None:
    """Write the report's lines in order into its own folder (never over the
    log); one file unless a histogram is very long."""
    summary_lines(parsed).orderBy("seq").select("line").write.mode("overwrite").text(path)


def write_comparison(compared: DataFrame, path: str) -> None:
    """One comparison document per image: ``compared`` has ``image_path``,
    ``content_extraction`` and ``image_labeling`` (VARIANT records)."""
    notes = F.struct(*[F.lit(v).alias(k) for k, v in C.COMPARISON_SUMMARY.items()])
    compared.select(F.to_json(F.struct("image_path", "content_extraction", "image_labeling", notes.alias("comparison_summary"))).alias("value")) \
        .write.mode("overwrite").text(path)


def write_dataset(root: str, images: DataFrame | None = None, labels: DataFrame | None = None,
                  label_rec_col: str | None = "rec", parsed_for_summary: DataFrame | None = None) -> dict:
    """Dataset layout: ``images/`` (Parquet path+content), ``labels/`` (JSON
    lines), ``summary/`` (report). Returns the folder of each part."""
    out = {"images": os.path.join(root, "images"), "labels": os.path.join(root, "labels"),
           "summary": os.path.join(root, "summary")}
    if images is not None:
        images.write.mode("overwrite").parquet(out["images"])
    if labels is not None:
        write_jsonl(labels, out["labels"], rec_col=label_rec_col)
    if parsed_for_summary is not None:
        write_summary(parsed_for_summary, out["summary"])
    return out


def step_status(steps: DataFrame, order: str | None = None) -> DataFrame:
    """Workflow summary: one row with every step's status and whether all succeeded.

    A step that was repeated counts with its last status by ``order`` (without
    it, the largest). The map has one entry for each step name.
    """
    last = F.max_by("status", order) if order else F.max("status")
    each = steps.groupBy("step").agg(last.alias("status"))
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "status")))).alias("steps"),
                    F.every(F.col("status") == "success").alias("all_ok"))


def write_step_status(steps: DataFrame, path: str, order: str | None = None) -> None:
    step_status(steps, order).write.mode("overwrite").json(path)
