"""Queries over fetch and attempt logs (download naming and outcomes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.operators import fetch as FT
from docsift.operators import joins as JN
from docsift.plans.registry import register
from docsift.sources.fixtures import duckdb_cte, fixture
from docsift.sources.tables import table

_EXT = f"""case when contains(content_type, 'jpeg') or contains(content_type, 'jpg') then '.jpg'
  when contains(content_type, 'png') then '.png' when contains(content_type, 'webp') then '.webp'
  when lower(regexp_extract(regexp_extract(url, '{FT.URL_PATH_RE}', 1), '{FT.SUFFIX_RE}', 1)) in ('.jpg', '.jpeg', '.png', '.webp')
    then lower(regexp_extract(regexp_extract(url, '{FT.URL_PATH_RE}', 1), '{FT.SUFFIX_RE}', 1))
  else '.jpg' end"""
_N = duckdb_cte("fetch_log") + f""", n as (select *, {_EXT} as ext,
  printf('image_%06d%s', row_number() over (order by ord) - 1, {_EXT}) as filename from fetch_log)
"""


@register("url_flags", """
select page_id, coalesce(starts_with(url, 'http://') or starts_with(url, 'https://'), false) as web_url from (
  select page_id, case page_id % 13 when 5 then 'ftp://' || url when 6 then null else url end as url from pages)""")
def url_flags(spark, sf_dir):
    kind = F.col("page_id") % 13
    url = F.when(kind == 5, F.concat(F.lit("ftp://"), F.col("url"))).when(kind == 6, F.lit(None).cast("string")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", FT.is_web_url(url).alias("web_url"))


@register("file_ext", duckdb_cte("fetch_log") + f"select ord, url, {_EXT} as ext from fetch_log")
def file_ext(spark, sf_dir):
    log = fixture(spark, sf_dir, "fetch_log")
    return log.select("ord", "url", FT.file_suffix(F.col("content_type"), F.col("url")).alias("ext"))


@register("file_names", _N + "select ord, filename from n")
def file_names(spark, sf_dir):
    return FT.name_files(fixture(spark, sf_dir, "fetch_log")).select("ord", "filename")


_O = _N + """, o as (select ord, url, case when status_code = 200 then 'saved' else 'skipped' end as outcome,
  case when status_code = 200 then filename end as path,
  case when status_code <> 200 then 'HTTP ' || cast(status_code as varchar) end as reason from n)
"""


@register("download_outcomes", _O + "select * from o")
def download_outcomes(spark, sf_dir):
    return FT.download_outcomes(FT.name_files(fixture(spark, sf_dir, "fetch_log")))


@register("download_map", _O + """
select url, arg_max(path, ord) as path, count(*) as downloads from o where outcome = 'saved' group by url""")
def download_map(spark, sf_dir):
    return FT.download_map(FT.download_outcomes(FT.name_files(fixture(spark, sf_dir, "fetch_log"))))


_R = duckdb_cte("attempt_log") + """, t as (select *, case when status_code = 200 then 'done'
    when status_code in (404, 403, 410) then 'gave_up' when exception_kind = 'network' then 'gave_up' end as kind
  from attempt_log where attempt <= 3),
 r as (select url, coalesce(min_by(kind, attempt) filter (where kind is not null), 'exhausted') as outcome,
  coalesce(min(attempt) filter (where kind is not null), max(attempt)) as attempts_used,
  nullif(min_by(coalesce(status_code, -1), attempt) filter (where kind is not null), -1) as final_status
 from t group by url)
"""


@register("fetch_outcomes", _R + "select * from r")
def fetch_outcomes(spark, sf_dir):
    return FT.resolve_attempts(fixture(spark, sf_dir, "attempt_log"))


@register("unseen_urls", _R + """
select distinct url from attempt_log a where not exists (select 1 from r where r.url = a.url and r.outcome = 'done')""")
def unseen_urls(spark, sf_dir):
    attempts = fixture(spark, sf_dir, "attempt_log")
    done = FT.resolve_attempts(attempts).filter(F.col("outcome") == "done").select("url")
    return JN.unmatched(attempts.select("url").distinct(), done, "url")


@register("download_counts", _O + """
select count(*) as attempted, count(*) filter (where outcome = 'saved') as downloaded,
  count(distinct url) filter (where outcome = 'saved') as distinct_saved from o""")
def download_counts(spark, sf_dir):
    o = FT.download_outcomes(FT.name_files(fixture(spark, sf_dir, "fetch_log")))
    saved = F.col("outcome") == "saved"
    return o.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(saved).alias("downloaded"),
                 F.count_distinct(F.when(saved, F.col("url"))).alias("distinct_saved"))
