"""Label logs: tolerant reading, overview, histograms, completeness, grades.

A label log holds one JSON object per line. A record *failed* when its top
level has the key ``error`` (even with a null value). Lines that are blank,
not JSON, or not an object are reported and left out of every total.

Every aggregate here is one pass over the parsed log with map-side partial
aggregation; the shuffled data is one row per (group, map task), independent
of the log size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators.numbering import with_position


def parse_log(lines: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Parse a text log into ``line_no, line, rec VARIANT, status``.

    ``status`` is ``ok`` / ``failed`` for records, and ``blank`` /
    ``invalid_json`` / ``not_object`` for lines that are not records.
    """
    J.allow_repeated_keys(lines.sparkSession)
    text = F.col(line)
    rec = J.parse_object(text)
    # ``rec`` comes out of a one-element generator: Catalyst cannot push a
    # predicate on it below the generator or copy the parse into each
    # consumer, so every line is parsed exactly once, after any repartition.
    parsed = lines.select(F.col(line_no).alias("line_no"), text.alias("line"),
                          F.inline(F.array(F.struct(rec.alias("rec")))))
    status = (F.when(F.col("rec").isNotNull(),
                     F.when(J.has_key(F.col("rec"), "error"), F.lit("failed")).otherwise(F.lit("ok")))
              .when(F.coalesce(J.strip_ws(F.col("line")), F.lit("")) == "", F.lit("blank"))
              .when(J.strict_parse(F.col("line")).isNull(), F.lit("invalid_json"))
              .otherwise(F.lit("not_object")))
    return parsed.withColumn("status", status)


def records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rec").isNotNull())


def successful(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") == "ok")


def invalid_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rec").isNull()).select("line_no", F.col("status").alias("reason"))


def _pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` in doubles; NULL when ``whole`` is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(100.0))


def overview(parsed: DataFrame) -> DataFrame:
    """Total, successful, failed and success percentage (0 for an empty log)."""
    agg = records(parsed).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("status") == "ok").alias("successful"),
    )
    return agg.select(
        "total_records", "successful",
        (F.col("total_records") - F.col("successful")).alias("failed"),
        F.coalesce(_pct(F.col("successful"), F.col("total_records")), F.lit(0.0)).alias("success_pct"),
    )


def histograms(parsed: DataFrame, fields=C.HISTOGRAM_FIELDS) -> DataFrame:
    """Counts per (dimension, value) over successful records.

    A missing key falls in ``Unknown``, an explicit null in ``None``.
    Percentages are of successful records; ``rank`` orders each histogram by
    count, ties by first appearance in the log.
    """
    rec = F.col("rec")
    pairs = F.array(*[F.struct(F.lit(f).alias("dimension"),
                               J.bucket_value(rec, f, C.MISSING_BUCKET, C.NULL_BUCKET).alias("value"))
                      for f in fields])
    long = successful(parsed).select("line_no", F.inline(pairs))
    counts = long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    # values are free text: rank them by ranges, not in one window per dimension
    counts = counts.withColumn("less", -F.col("n"))
    placed = with_position(counts, ["dimension", "less", "first_line", "value"], "pos")
    totals = placed.groupBy("dimension").agg(F.sum("n").alias("all"), F.min("pos").alias("first"))
    return placed.join(totals, "dimension").select(
        "dimension", "value", "n", _pct(F.col("n"), F.col("all")).alias("pct"),
        (F.col("pos") - F.col("first") + 1).cast("int").alias("rank"),
    )


def _field_counts(parsed: DataFrame, required, important) -> DataFrame:
    """One-row wide aggregate: totals and non-null counts per field."""
    rec = F.col("rec")
    ok = F.col("status") == "ok"
    all_required = F.lit(True)
    for f in required:
        all_required = all_required & J.non_null(rec, f)
    aggs = [F.count(F.lit(1)).alias("total_records"),
            F.count_if(ok & all_required).alias("valid_classifications")]
    aggs += [F.count_if(ok & J.non_null(rec, f)).alias(f"present__{f}") for f in (*required, *important)]
    return records(parsed).agg(*aggs)


def field_completeness(parsed: DataFrame, required=C.REQUIRED_LABEL_FIELDS,
                       important=C.IMPORTANT_LABEL_FIELDS) -> DataFrame:
    """``field, kind, present, total_records, pct, grade`` per checked field.

    ``present`` counts non-error records where the key exists and is not null
    (empty strings and lists count). ``pct`` is of all parsed records. Grade:
    required and >= 90 -> ok; else >= 70 -> warn; else bad.
    """
    wide = _field_counts(parsed, required, important)
    entries = [F.struct(F.lit(i).alias("field_order"), F.lit(f).alias("field"),
                        F.lit("required" if f in required else "important").alias("kind"),
                        F.col(f"present__{f}").alias("present"))
               for i, f in enumerate((*required, *important))]
    long = wide.select("total_records", F.inline(F.array(*entries)))
    pct = _pct(F.col("present"), F.col("total_records"))
    grade = (F.when(pct.isNull(), F.lit(None).cast("string"))
             .when((F.col("kind") == "required") & (pct >= C.GRADE_OK_PCT), F.lit(C.GRADE_OK))
             .when(pct >= C.GRADE_WARN_PCT, F.lit(C.GRADE_WARN))
             .otherwise(F.lit(C.GRADE_BAD)))
    return long.select("field_order", "field", "kind", "present", "total_records",
                       pct.alias("pct"), grade.alias("grade"))


def validation_summary(parsed: DataFrame, required=C.REQUIRED_LABEL_FIELDS,
                       important=C.IMPORTANT_LABEL_FIELDS) -> DataFrame:
    """One row: total records, records with every required field, percentage,
    and the per-field counts as a map (the validator's return value)."""
    wide = _field_counts(parsed, required, important)
    fields = (*required, *important)
    completeness = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]),
                                     F.array(*[F.col(f"present__{f}") for f in fields]))
    return wide.select("total_records", "valid_classifications",
                       _pct(F.col("valid_classifications"), F.col("total_records")).alias("valid_pct"),
                       completeness.alias("field_completeness"))


# --- views over successful records -------------------------------------------

def _joined(arr: Column, k: int) -> Column:
    """First ``k`` list items joined by ', ' ('' for a missing or null list)."""
    return F.coalesce(F.array_join(F.slice(arr, 1, k), ", "), F.lit(""))


def image_path(rec: Column) -> Column:
    """The image a record is about (its ``_metadata``)."""
    return J.get_str(rec, "_metadata.image_path")


def top_items(parsed: DataFrame) -> DataFrame:
    """First three testing scenarios and first five sensitive data types."""
    rec = F.col("rec")
    return successful(parsed).select(
        "line_no",
        _joined(J.get_str_array(rec, "testing_scenarios"), 3).alias("scenarios_top3"),
        _joined(J.get_str_array(rec, "sensitive_data_types"), 5).alias("sensitive_top5"),
    )


def ocr_view(parsed: DataFrame) -> DataFrame:
    rec = F.col("rec")
    return successful(parsed).select(
        "line_no", image_path(rec).alias("image_path"),
        J.get_str(rec, "ocr_difficulty").alias("difficulty"),
        J.get_str(rec, "text_clarity").alias("text_clarity"),
        J.get_str(rec, "language_primary").alias("language"),
    )


def dlp_view(parsed: DataFrame, flat: bool = False) -> DataFrame:
    """Sensitive data types, category and testing scenarios per record.

    With ``flat`` the lists are rendered as comma-joined text plus a count.
    """
    rec = F.col("rec")
    sens = J.get_str_array(rec, "sensitive_data_types")
    scen = J.get_str_array(rec, "testing_scenarios")
    if not flat:
        return successful(parsed).select("line_no", image_path(rec).alias("image_path"), sens.alias("sensitive_data"),
                                         J.get_str(rec, "document_category").alias("document_type"),
                                         scen.alias("testing_scenarios"))
    return successful(parsed).select(
        "line_no", image_path(rec).alias("image_path"),
        F.array_join(sens, ",").alias("sensitive_data"),
        F.when(sens.isNotNull(), F.size(sens)).cast("bigint").alias("n_sensitive"),
        J.get_str(rec, "document_category").alias("document_type"),
        F.array_join(scen, ",").alias("testing_scenarios"),
    )


def classification_view(parsed: DataFrame) -> DataFrame:
    rec = F.col("rec")
    return successful(parsed).select(
        "line_no", image_path(rec).alias("image_path"),
        J.get_str(rec, "document_category").alias("category"),
        J.get_str(rec, "document_subcategory").alias("subcategory"),
        J.get_double(rec, "confidence_score").alias("confidence"),
    )


def failure_hint(error_text: Column) -> Column:
    """rate_limit / auth / unexpected, from markers in the error text."""
    low = F.lower(F.coalesce(error_text, F.lit("")))
    rate = F.lit(False)
    for m in C.RATE_LIMIT_MARKERS:
        rate = rate | low.contains(m)
    auth = F.lit(False)
    for m in C.AUTH_MARKERS:
        auth = auth | low.contains(m)
    return F.when(rate, F.lit("rate_limit")).when(auth, F.lit("auth")).otherwise(F.lit("unexpected"))


def failure_hints(parsed: DataFrame) -> DataFrame:
    err = J.get_str(F.col("rec"), "error")
    return (parsed.filter(F.col("status") == "failed")
            .select("line_no", err.alias("error"), failure_hint(err).alias("hint")))
