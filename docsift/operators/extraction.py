"""Invoice extraction logs: per-record field presence, key values, tokens, checks.

Records share the label-log reading (``labels.parse_log``): ``ok`` records
have no top-level ``error`` key, ``failed`` ones do, and unparseable lines
carry ``invalid_json`` / ``blank`` / ``not_object``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators import labels as L


def overview(parsed: DataFrame) -> DataFrame:
    """Lines, records, successful, failed, parse errors and success percentage."""
    st = F.col("status")
    agg = parsed.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("rec").isNotNull()).alias("total_records"),
        F.count_if(st == "ok").alias("successful"),
        F.count_if(st == "failed").alias("failed"),
        F.count_if(F.col("rec").isNull()).alias("parse_errors"),
    )
    pct = F.when(F.col("total_records") > 0,
                 F.col("successful").cast("double") / F.col("total_records").cast("double") * F.lit(100.0))
    return agg.withColumn("success_pct", F.coalesce(pct, F.lit(0.0)))


def field_presence(parsed: DataFrame, required=C.REQUIRED_EXTRACTION_FIELDS,
                   optional=C.OPTIONAL_EXTRACTION_FIELDS) -> DataFrame:
    """Per line: status and, for ok records, present/missing field counts.

    ``missing_required`` lists the missing required fields in their fixed
    order, joined by ', '. A field counts when present and not null.
    """
    rec = F.col("rec")
    ok = F.col("status") == "ok"
    # presence flags computed once per row; counts and the missing list read them
    flags = parsed.select(
        "line_no", "status", F.when(ok, J.get_str(rec, "_metadata.image_path")).alias("image_path"),
        F.array(*[J.non_null(rec, f) for f in required]).alias("_req"),
        F.array(*[J.non_null(rec, f) for f in optional]).alias("_opt"))
    count_true = lambda arr: F.aggregate(arr, F.lit(0), lambda a, x: a + x.cast("int"))
    names = F.array(*[F.lit(f) for f in required])
    missing = F.array_join(F.filter(names, lambda x, i: ~F.get(F.col("_req"), i)), ", ")
    return flags.select(
        "line_no", "status", "image_path",
        F.when(ok, count_true(F.col("_req"))).alias("required_present"),
        F.when(ok, count_true(F.col("_opt"))).alias("optional_present"),
        F.when(ok, missing).alias("missing_required"),
    )


def key_info(parsed: DataFrame, fields=C.KEY_INFO_FIELDS) -> DataFrame:
    """Long form ``line_no, key, value`` of the chosen fields that are not null."""
    rec = F.col("rec")
    entries = F.array(*[F.struct(F.lit(i).alias("key_order"), F.lit(f).alias("key"),
                                 F.when(J.non_null(rec, f), J.scalar_text(rec, f)).alias("value"))
                        for i, f in enumerate(fields)])
    return (L.successful(parsed).select("line_no", F.inline(entries))
            .filter(F.col("value").isNotNull()))


def token_totals(parsed: DataFrame) -> DataFrame:
    """Summed prompt and completion tokens of successful records."""
    rec = F.col("rec")
    p = F.try_variant_get(rec, "$._metadata.api_response_tokens.prompt_tokens", "bigint")
    c = F.try_variant_get(rec, "$._metadata.api_response_tokens.completion_tokens", "bigint")
    return L.successful(parsed).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(p).alias("prompt_tokens"),
        F.sum(c).alias("completion_tokens"),
        F.sum(F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0))).alias("total_tokens"),
    )


def quality_flags(parsed: DataFrame) -> DataFrame:
    """Downstream type checks: numeric amount, confidence in [0, 1], parseable date."""
    rec = F.col("rec")
    conf = J.get_double(rec, "confidence_score")
    date = F.try_to_date(J.get_str(rec, "invoice_date"), "yyyy-MM-dd")
    return L.successful(parsed).select(
        "line_no",
        J.is_number(rec, "total_amount").alias("amount_is_number"),
        F.coalesce(conf.between(0.0, 1.0), F.lit(False)).alias("confidence_ok"),
        date.isNotNull().alias("date_ok"),
        F.try_variant_get(rec, "$.total_amount", "decimal(18,2)").alias("total_amount"),
    )
