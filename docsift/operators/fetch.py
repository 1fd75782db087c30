"""Downloads as data: file suffixes and names, attempt resolution, URL maps.

A fetch log has one row per URL in list order (``ord``) with the response
status and content type; an attempt log has one row per try of a URL.
Nothing here performs network I/O; ``operators.service`` does that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators.numbering import with_position

# path part of a URL (after scheme and authority, before query and fragment)
URL_PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
# suffix by the splitext rule: last dot of the last segment, not a leading dot
SUFFIX_RE = r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATH_RE, 1)


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(path, SUFFIX_RE, 1)


def is_web_url(url: Column) -> Column:
    """The URL starts with http:// or https:// (downstream format check)."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


def file_suffix(content_type: Column, url: Column) -> Column:
    """Suffix from the content type (case-sensitive, first match), else the
    URL path suffix when it is a known image suffix, else ``.jpg``."""
    ct = F.coalesce(content_type, F.lit(""))
    from_url = F.lower(path_suffix(url_path(url)))
    fallback = F.when(from_url.isin(*C.DOWNLOAD_SUFFIXES), from_url).otherwise(F.lit(C.DEFAULT_SUFFIX))
    return (F.when(ct.contains("jpeg") | ct.contains("jpg"), F.lit(".jpg"))
            .when(ct.contains("png"), F.lit(".png"))
            .when(ct.contains("webp"), F.lit(".webp"))
            .otherwise(fallback))


def file_name(index: Column, suffix: Column) -> Column:
    return F.format_string(C.FILE_NAME_FORMAT + "%s", index, suffix)


def name_files(fetch_log: DataFrame, order: str = "ord") -> DataFrame:
    """Every row gets ``file_index`` (0-based position in the whole list,
    failed rows included) and ``filename``."""
    ranked = with_position(fetch_log, [order], "file_index", start=0)
    return ranked.withColumn("ext", file_suffix(F.col("content_type"), F.col("url"))) \
                 .withColumn("filename", file_name(F.col("file_index"), F.col("ext")))


def download_outcomes(named: DataFrame) -> DataFrame:
    """One try per URL: 200 saves the file, anything else is skipped."""
    ok = F.col("status_code") == 200
    return named.select(
        "ord", "url",
        F.when(ok, F.lit("saved")).otherwise(F.lit("skipped")).alias("outcome"),
        F.when(ok, F.col("filename")).alias("path"),
        F.when(~ok, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("reason"),
    )


def download_map(outcomes: DataFrame) -> DataFrame:
    """url -> saved path; a URL saved twice keeps its last path."""
    saved = outcomes.filter(F.col("outcome") == "saved")
    return saved.groupBy("url").agg(F.max_by("path", "ord").alias("path"),
                                    F.count(F.lit(1)).alias("downloads"))


def resolve_attempts(attempts: DataFrame, max_attempts: int = C.RETRY_ATTEMPTS) -> DataFrame:
    """Outcome per URL from its attempts, in attempt order, at most ``max_attempts``.

    200 -> done; 403/404/410 -> gave_up; a network error -> gave_up; a timeout,
    another status or another error -> next attempt; none left -> exhausted.
    One aggregate per URL: the earliest terminal attempt decides.
    """
    st, ex = F.col("status_code"), F.col("exception_kind")
    kind = (F.when(st == 200, F.lit("done"))
            .when(st.isin(*C.GIVE_UP_STATUSES), F.lit("gave_up"))
            .when(ex == "network", F.lit("gave_up")))
    tried = attempts.filter(F.col("attempt") <= max_attempts).withColumn("_kind", kind)
    first_terminal = F.min(F.when(F.col("_kind").isNotNull(),
                                  F.struct(F.col("attempt").alias("a"), F.col("_kind").alias("k"),
                                           st.alias("s"))))
    per_url = tried.groupBy("url").agg(first_terminal.alias("t"), F.max("attempt").alias("last"))
    return per_url.select(
        "url",
        F.coalesce(F.col("t.k"), F.lit("exhausted")).alias("outcome"),
        F.coalesce(F.col("t.a"), F.col("last")).alias("attempts_used"),
        F.col("t.s").alias("final_status"),
    )
