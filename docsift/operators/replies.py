"""Model replies -> label / extraction records or error records (as data).

A reply row carries the call outcome: ``status_code``, ``exception_kind``
(``timeout``, ``network``, other text, or NULL), an optional exception
message, and the reply ``content``. The record is built per row with
built-in expressions; no Python runs per reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J


#: What ``json_error`` says; the position of the fault is not reported.
JSON_ERROR = "reply is not valid JSON"


def outcome(status: Column, exception_kind: Column, content: Column, message: Column | None = None,
            flavour: str = "label") -> Column:
    """STRUCT<has_error, error, json_text, raw_response, json_error, error_details, rec VARIANT>.

    ``processing``: the row failed outside the call (say, an unreadable file).
    Labels: timeout -> fixed text; network -> 'Network error: ' + message;
    other exception -> prefix + message. Extraction: every exception gets the
    generic prefix. Non-200 -> status text with the body as details. 200 ->
    the JSON inside the reply; unparseable -> parse error with the raw text;
    a value that is not an object cannot take metadata -> generic error.
    """
    msg = F.coalesce(message, exception_kind) if message is not None else exception_kind
    text = J.reply_json_text(F.coalesce(content, F.lit("")))
    parsed = J.strict_parse(text)
    is_obj = J.is_object_text(text) & parsed.isNotNull()
    processing = C.ERR_PROCESSING_PREFIX if flavour == "label" else C.ERR_PROCESSING_EXTRACTION_PREFIX
    if flavour == "label":
        exc = (F.when(exception_kind == "timeout", F.lit(C.ERR_TIMEOUT))
               .when(exception_kind == "network", F.concat(F.lit(C.ERR_NETWORK_PREFIX), msg))
               .otherwise(F.concat(F.lit(C.ERR_OTHER_PREFIX), msg)))
    else:
        exc = F.concat(F.lit(C.ERR_OTHER_PREFIX), msg)
    exc = F.when(exception_kind == "processing", F.concat(F.lit(processing), msg)).otherwise(exc)
    ok200 = status == 200
    error = (F.when(exception_kind.isNotNull(), exc)
             .when(~ok200, F.concat(F.lit(C.ERR_STATUS_PREFIX), status.cast("string")))
             .when(parsed.isNull(), F.lit(C.ERR_JSON))
             .when(~is_obj, F.concat(F.lit(C.ERR_OTHER_PREFIX), F.lit("reply is not a JSON object"))))
    no_exc = exception_kind.isNull()
    return F.struct(
        error.isNotNull().alias("has_error"),
        error.alias("error"),
        F.when(no_exc & ok200, text).alias("json_text"),
        F.when(no_exc & ok200 & parsed.isNull(), text).alias("raw_response"),
        F.when(no_exc & ok200 & parsed.isNull(), F.lit(JSON_ERROR)).alias("json_error"),
        F.when(no_exc & ~ok200, content).alias("error_details"),
        F.when(error.isNull(), parsed).alias("rec"),
    )


def with_outcome(replies: DataFrame, flavour: str = "label") -> DataFrame:
    msg = F.col("exception_message") if "exception_message" in replies.columns else None
    return replies.withColumn("o", outcome(F.col("status_code"), F.col("exception_kind"), F.col("content"),
                                           msg, flavour))


def with_metadata(records: DataFrame, image_path: Column, image_info: Column | None, timestamp: Column, model: str,
                  tokens: Column | None = None, flavour: str = "label") -> DataFrame:
    """Attach ``_metadata`` to every record of :func:`with_outcome`.

    All records have the image path and info; those without an error also the
    time (an input column, so reruns agree; named by flavour), the model, the
    tokens and, for labels, the purpose.
    """
    ok = ~F.col("o.has_error")
    fields = [image_path.alias("image_path"), (F.lit(None).cast("string") if image_info is None else image_info).alias("image_info")]
    name = "classification_timestamp" if flavour == "label" else "analysis_timestamp"
    fields += [F.when(ok, timestamp).alias(name), F.when(ok, F.lit(model)).alias("model_used"),
               F.when(ok, F.lit(None).cast("string") if tokens is None else tokens).alias("api_response_tokens")]
    if flavour == "label":
        fields.append(F.when(ok, F.lit(C.METADATA_PURPOSE)).alias("purpose"))
    return records.withColumn("_metadata", F.struct(*fields))


def with_file_info(records: DataFrame, path: Column, order: Column) -> DataFrame:
    """Attach ``_file_info`` (file name, path, 1-based processing order)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return records.withColumn("_file_info", F.struct(name.alias("filename"), path.alias("file_path"),
                                                     order.cast("int").alias("processing_order")))


def record_text(records: DataFrame, out: str = "line") -> DataFrame:
    """One JSON line per record in column ``out``: the reply's own fields (or the
    error's), then ``_metadata`` and ``_file_info`` where they are attached."""
    own = F.when(F.col("o.has_error"), F.to_json(F.struct(*[F.col(f"o.{k}").alias(k) for k in ("error", "raw_response", "json_error", "error_details")]))
                 ).otherwise(F.to_json("o.rec"))
    inner = [F.when(F.length(own) > 2, F.substring(own, F.lit(2), F.length(own) - 2))]
    for extra in ("_metadata", "_file_info"):
        if extra in records.columns:
            inner.append(F.concat(F.lit(f'"{extra}":'), F.to_json(extra)))
    return records.withColumn(out, F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}")))
