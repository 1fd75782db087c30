"""Image metadata projections and quality filters.

Inputs are rows of image metadata (``file_size, format, width, height, mode,
decodable``), as produced by ``sources.images`` from stored files or taken
from a metadata table. The rules are applied in a fixed order and the first
failing rule is reported, so one ``reject_reason`` column replaces the log
lines of a sequential filter. Size is checked first: on a ``binaryFile`` scan
that predicate is pushed to the file listing, before any bytes are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import constants as C


@dataclass(frozen=True)
class FilterRules:
    min_side: int = C.MIN_SIDE
    max_side: int = C.MAX_SIDE
    min_bytes: int = C.MIN_FILE_BYTES
    max_bytes: int = C.MAX_FILE_BYTES
    formats: tuple = C.ALLOWED_FORMATS
    max_aspect: int = C.MAX_ASPECT


def reject_reason(rules: FilterRules = FilterRules(), size="file_size", fmt="format", w="width", h="height",
                  ok="decodable") -> Column:
    """First failing rule: file_size, format, dimensions, aspect_ratio, undecodable; NULL passes."""
    size, fmt, w, h, ok = (F.col(x) for x in (size, fmt, w, h, ok))
    unknown = F.lit(True)  # a value that could not be read fails its rule
    bad_dims = (w < rules.min_side) | (h < rules.min_side) | (w > rules.max_side) | (h > rules.max_side)
    # max/min > k  <=>  max > k*min for positive integer sides (no float rounding)
    bad_aspect = F.greatest(w, h) > F.least(w, h) * rules.max_aspect
    return (F.when(F.coalesce((size < rules.min_bytes) | (size > rules.max_bytes), unknown), F.lit("file_size"))
            .when(F.coalesce(~fmt.isin(*rules.formats), unknown), F.lit("format"))
            .when(F.coalesce(bad_dims, unknown), F.lit("dimensions"))
            .when(F.coalesce(bad_aspect, unknown), F.lit("aspect_ratio"))
            .when(~F.coalesce(ok, F.lit(False)), F.lit("undecodable")))


def apply_filter(df: DataFrame, rules: FilterRules = FilterRules()) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(rules)) \
             .withColumn("accepted", F.col("reject_reason").isNull())


def reason_counts(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")) \
                   .agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame) -> DataFrame:
    """Image info with transparency and the payload re-encode flag.

    An image is transparent by its mode, or by a marker in its header
    (column ``transparency``, where there is one)."""
    by_mode = F.col("mode").isin(*C.TRANSPARENT_MODES)
    marked = F.coalesce(F.col("transparency"), F.lit(False)) if "transparency" in df.columns else F.lit(False)
    return df.select(
        "file_id", "filename", "format", "width", "height", "mode", "file_size",
        (by_mode | marked).alias("has_transparency"),
        (F.col("file_size") > C.MAX_PAYLOAD_BYTES).alias("needs_reencode"),
    )


# caller-tuned checks used after a download (all require a decodable image)
TUNED_CHECKS = {
    "min100_5k": lambda w, h, s: (w >= 100) & (h >= 100) & (s >= 5000),
    "min200_10k": lambda w, h, s: (w >= 200) & (h >= 200) & (s >= 10000),
    "open50_10000": lambda w, h, s: (s > 1000) & (w > 50) & (h > 50) & (w < 10000) & (h < 10000),
}


def tuned_counts(df: DataFrame) -> DataFrame:
    """Accepted rows per tuned variant, and for the default rules, in one pass."""
    w, h, s, ok = F.col("width"), F.col("height"), F.col("file_size"), F.col("decodable")
    aggs = [F.count_if(ok & fn(w, h, s)).alias(name) for name, fn in TUNED_CHECKS.items()]
    aggs.append(F.count_if(reject_reason().isNull()).alias("default"))
    names = [*TUNED_CHECKS, "default"]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("n_accepted"))
                                         for n in names])))


def label_scan_filter(name_col: Column) -> Column:
    """File names the labeler picks up: lower-cased suffix in its list."""
    low = F.lower(name_col)
    cond = F.lit(False)
    for suf in C.LABEL_SCAN_SUFFIXES:
        cond = cond | low.endswith(suf)
    return cond
