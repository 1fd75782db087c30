"""End-to-end jobs composed from sources, operators and sinks.

Each job is a plain function from paths / DataFrames to DataFrames (and
files), replacing the command-line entry points: crawl, download
resolution, label, extract, summarize, validate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators import dedup as DD
from docsift.operators import extraction as X
from docsift.operators import fetch as FT
from docsift.operators import images as I
from docsift.operators import labels as L
from docsift.operators import replies as R
from docsift.operators import search as S
from docsift.operators.requests import EXTRACT_PARAMS, LABEL_PARAMS, needs_reencode, request_body
from docsift.operators.service import call_once
from docsift.operators.numbering import with_position
from docsift.session import scratch_dir, write_table
from docsift.sinks import writers as W
from docsift.sources import files as FS
from docsift.sources import images as IM
from docsift.sources.image_folder import with_content


def crawl(responses: DataFrame, max_images: int = 500, keywords: list[str] | None = None) -> DataFrame:
    """Stored search responses -> the URL list of a mixed-engine crawl."""
    if keywords is not None:
        responses = responses.filter(F.col("keyword").isin(*keywords))
    return S.crawl_selection(responses, max_images=max_images, n_keywords=len(set(keywords)) if keywords else None)


def downloads(fetch_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch log -> (per-URL outcomes with file names, url -> path map)."""
    outcomes = FT.download_outcomes(FT.name_files(fetch_log))
    return outcomes, FT.download_map(outcomes)


def accept_images(spark: SparkSession, folder: str, store_path: str | None = None,
                  rules: I.FilterRules = I.FilterRules(), threshold: int = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Filter then de-duplicate a folder of images: ``path, status``, one row per
    listed file.

    ``invalid``: a rule failed. ``duplicate``: near a stored hash, or near an
    earlier accepted file in path order. ``accepted``: the rest; a file that
    passes the rules but has no pixel hash (WebP) cannot be a duplicate.
    Only files within the size bounds are opened. New hashes are added to the
    store, if one is named.
    """
    listed = write_table(FS.scan_images(spark, folder, "dedup"), "accept-listed")
    sized = listed.filter(F.col("length").between(rules.min_bytes, rules.max_bytes))
    # one folder, not recursive: the file name is unique
    hashes = IM.hash_images(spark, folder)
    rows = (IM.image_info(sized).join(hashes, "name", "left")
            .withColumn("decodable", F.col("bits").isNotNull() | (F.col("format") == "WEBP")))
    passed = write_table(I.apply_filter(rows, rules).filter("accepted").select("path", "name", "bits"), "accept-passed")
    hashed = with_position(passed.filter("bits IS NOT NULL"), ["path"], "ord", start=1)
    hashed = write_table(hashed, "accept-hashed")
    index = FS.store_index(spark, store_path, threshold) if store_path else None
    status = write_table(DD.incremental(hashed.select("ord", "bits"), index, threshold), "accept-status")
    checked = hashed.join(status, "ord").select("path", "ord", "bits", F.col("status").alias("found"))
    out = (listed.select("path").join(passed.select("path", F.lit(True).alias("passed")), "path", "left")
           .join(checked.select("path", "found"), "path", "left")
           .select("path", F.when(F.col("passed").isNull(), F.lit("invalid"))
                   .when(F.col("found") == "duplicate", F.lit("duplicate")).otherwise(F.lit("accepted")).alias("status")))
    if store_path:
        batch = (FS.read_store(spark, store_path).agg(F.max("batch_id")).first()[0] or 0) + 1
        fresh = write_table(DD.with_hash(checked.filter(F.col("found") == "new")).withColumn("file", F.col("path")), "accept-fresh")
        W.append_store(fresh, store_path, batch)
        index.append(fresh, batch)
    return out


def label(spark: SparkSession, folder: str, client_factory: Callable, prompt: str, model: str, timestamp: str,
          partitions: int | None = None, flavour: str = "label", log_dir: str | None = None, summary_dir: str | None = None,
          ledger: str | None = None) -> DataFrame:
    """Label every image of a folder through a service; failures stay as rows.

    Replies go to a ledger before they are parsed (see ``service.call_once``), so
    neither a task nor a job that runs again repeats a committed call; name a
    ``ledger`` folder to keep it for later runs (default: one in the checkpoint
    root). An image above the payload limit is not sent, but recorded as failed.
    ``log_dir`` gets the JSON-lines log, ``summary_dir`` the report.
    """
    J.allow_repeated_keys(spark)
    files = write_table(FS.scan_images(spark, folder, "label" if flavour == "label" else "extract"), "label-files")
    numbered = FS.number_files(files, flavour).select("path", "name", "length", "processing_order")
    params = LABEL_PARAMS if flavour == "label" else EXTRACT_PARAMS
    reqs = with_content(files.filter(~needs_reencode(F.col("length")))).select("path", request_body(F.col("content"), prompt, model, params).alias("request"))
    replies = write_table(call_once(reqs, "path", "request", client_factory, ledger or scratch_dir(spark, "ledger"), partitions=partitions), "replies")
    info = write_table(IM.image_info(files).select("path", F.struct("name", "file_size", "format", "width", "height", "mode").alias("image_info")), "label-info")
    out = numbered.join(replies, "path", "left").join(info, "path", "left")
    unsent = F.col("attempts").isNull()
    out = out.withColumn("exception_kind", F.when(unsent, F.lit("processing")).otherwise(F.col("exception_kind"))).withColumn(
        "exception_message", F.when(unsent, F.lit("image is above the payload limit and needs re-encoding")).otherwise(F.col("exception_message")))
    out = R.with_metadata(R.with_outcome(out, flavour), F.col("path"), F.col("image_info"), F.lit(timestamp), model, flavour=flavour)
    out = R.record_text(R.with_file_info(out, F.col("path"), F.col("processing_order")))
    if log_dir:
        out.orderBy("processing_order").select(F.col("line").alias("value")).write.mode("overwrite").text(log_dir)
        if summary_dir:
            summarize(spark, log_dir, summary_dir)
    return out


def pipeline(spark: SparkSession, responses: DataFrame, fetch_log: DataFrame, folder: str, root: str, client_factory: Callable,
             prompt: str, model: str, timestamp: str, max_images: int = 500) -> dict[str, DataFrame]:
    """Search responses -> URL list -> downloads -> labels -> report, laid out
    under ``root``; ``folder`` holds the downloaded images."""
    urls = write_table(crawl(responses, max_images), "pipeline-urls")
    W.write_url_list(urls, f"{root}/urls", order="seq")
    outcomes, mapping = downloads(fetch_log.join(urls.select("url"), "url", "left_semi"))
    parts = {"labels": f"{root}/labels", "summary": f"{root}/summary"}
    labels = label(spark, folder, client_factory, prompt, model, timestamp, log_dir=parts["labels"], summary_dir=parts["summary"])
    return {"urls": urls, "outcomes": outcomes, "map": mapping, "labels": labels}


def validate(spark: SparkSession, log_path: str) -> dict[str, DataFrame]:
    """Label-log validation: summary row, per-field grades, invalid lines."""
    parsed = L.parse_log(FS.read_lines(spark, log_path))
    return {"summary": L.validation_summary(parsed), "fields": L.field_completeness(parsed),
            "invalid_lines": L.invalid_lines(parsed)}


def summarize(spark: SparkSession, log_path: str, out_dir: str) -> DataFrame:
    """Write the markdown summary of a label log into ``out_dir``; return its lines."""
    parsed = L.parse_log(FS.read_lines(spark, log_path))
    W.write_summary(parsed, out_dir)
    return W.summary_lines(parsed)


def validate_extraction(spark: SparkSession, log_path: str) -> dict[str, DataFrame]:
    parsed = L.parse_log(FS.read_lines(spark, log_path))
    return {"overview": X.overview(parsed), "presence": X.field_presence(parsed), "key_info": X.key_info(parsed),
            "flags": X.quality_flags(parsed), "tokens": X.token_totals(parsed)}
