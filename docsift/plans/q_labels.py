"""Queries over the label log (validation, summary report, training views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators import labels as L
from docsift.operators import joins as JN
from docsift.plans import duck as D
from docsift.plans.registry import register
from docsift.sources.fixtures import duckdb_cte, fixture


def parsed_labels(spark, sf_dir):
    return L.parse_log(fixture(spark, sf_dir, "label_log"))


_P = duckdb_cte("label_log") + ", p as (" + D.parsed("label_log") + ")\n"
_S = _P + ", s as (select * from p where status = 'ok')\n"


@register("label_overview", _P + """
select count(*) as total_records, count(*) filter (where status = 'ok') as successful,
  count(*) filter (where status = 'failed') as failed,
  coalesce(""" + D.pct("count(*) filter (where status = 'ok')", "count(*)") + """, 0.0) as success_pct
from p where rec is not null""")
def label_overview(spark, sf_dir):
    return L.overview(parsed_labels(spark, sf_dir))


_hist_long = "\n union all ".join(
    f"select line_no, '{f}' as dimension, {D.bucket('rec', f)} as value from s" for f in C.HISTOGRAM_FIELDS)


@register("label_histograms", _S + f""", l as ({_hist_long}),
 c as (select dimension, value, count(*) as n, min(line_no) as first_line from l group by dimension, value)
select dimension, value, n, {D.pct('n', 'sum(n) over (partition by dimension)')} as pct,
  cast(row_number() over (partition by dimension order by n desc, first_line) as integer) as rank
from c""")
def label_histograms(spark, sf_dir):
    return L.histograms(parsed_labels(spark, sf_dir))


_fields = (*C.REQUIRED_LABEL_FIELDS, *C.IMPORTANT_LABEL_FIELDS)
_counts = ",\n  ".join(
    f"count(*) filter (where status = 'ok' and {D.nonnull('rec', f)}) as \"{f}\"" for f in _fields)
_all_req = " and ".join(D.nonnull("rec", f) for f in C.REQUIRED_LABEL_FIELDS)
_W = _P + f""", w as (select count(*) as total_records,
  count(*) filter (where status = 'ok' and {_all_req}) as valid_classifications,
  {_counts}
 from p where rec is not null)
"""
_unpivot = "\n union all ".join(
    f"select {i} as field_order, '{f}' as field, '{'required' if f in C.REQUIRED_LABEL_FIELDS else 'important'}' as kind, "
    f"\"{f}\" as present, total_records from w" for i, f in enumerate(_fields))


@register("field_completeness", _W + f"""
select cast(field_order as integer) as field_order, field, present from ({_unpivot})""")
def field_completeness(spark, sf_dir):
    return L.field_completeness(parsed_labels(spark, sf_dir)).select("field_order", "field", "present")


@register("field_grades", _W + f""", u as ({_unpivot})
select cast(field_order as integer) as field_order, field, kind, present, total_records,
  {D.pct('present', 'total_records')} as pct,
  case when total_records = 0 then null
       when kind = 'required' and {D.pct('present', 'total_records')} >= {C.GRADE_OK_PCT} then '{C.GRADE_OK}'
       when {D.pct('present', 'total_records')} >= {C.GRADE_WARN_PCT} then '{C.GRADE_WARN}'
       else '{C.GRADE_BAD}' end as grade
from u""")
def field_grades(spark, sf_dir):
    return L.field_completeness(parsed_labels(spark, sf_dir))


@register("valid_labels", _W + f"""
select total_records, valid_classifications, {D.pct('valid_classifications', 'total_records')} as valid_pct from w""")
def valid_labels(spark, sf_dir):
    return L.validation_summary(parsed_labels(spark, sf_dir)).drop("field_completeness")


@register("invalid_lines", _P + "select line_no, status as reason from p where rec is null")
def invalid_lines(spark, sf_dir):
    return L.invalid_lines(parsed_labels(spark, sf_dir))


def _dk_join(rec, key, k, sep=", "):
    return f"coalesce(array_to_string(list_slice({D.str_list(rec, key)}, 1, {k}), '{sep}'), '')"


@register("top_scenarios", _S + f"""
select line_no, {_dk_join('rec', 'testing_scenarios', 3)} as scenarios_top3,
  {_dk_join('rec', 'sensitive_data_types', 5)} as sensitive_top5 from s""")
def top_scenarios(spark, sf_dir):
    return L.top_items(parsed_labels(spark, sf_dir))


@register("ocr_view", _S + f"""
select line_no, rec ->> '$._metadata.image_path' as image_path, {D.get_str('rec', 'ocr_difficulty')} as difficulty, {D.get_str('rec', 'text_clarity')} as text_clarity,
  {D.get_str('rec', 'language_primary')} as language from s""")
def ocr_view(spark, sf_dir):
    return L.ocr_view(parsed_labels(spark, sf_dir))


@register("dlp_view", _S + f"""
select line_no, rec ->> '$._metadata.image_path' as image_path, array_to_string({D.str_list('rec', 'sensitive_data_types')}, ',') as sensitive_data,
  cast(len({D.str_list('rec', 'sensitive_data_types')}) as bigint) as n_sensitive,
  {D.get_str('rec', 'document_category')} as document_type,
  array_to_string({D.str_list('rec', 'testing_scenarios')}, ',') as testing_scenarios from s""")
def dlp_view(spark, sf_dir):
    return L.dlp_view(parsed_labels(spark, sf_dir), flat=True)


@register("classification_view", _S + f"""
select line_no, rec ->> '$._metadata.image_path' as image_path, {D.get_str('rec', 'document_category')} as category, {D.get_str('rec', 'document_subcategory')} as subcategory,
  try_cast({D.get_str('rec', 'confidence_score')} as double) as confidence from s""")
def classification_view(spark, sf_dir):
    return L.classification_view(parsed_labels(spark, sf_dir))


@register("failure_hints", _P + f"""
select line_no, {D.get_str('rec', 'error')} as error,
  case when lower(coalesce({D.get_str('rec', 'error')}, '')) like '%429%' or lower(coalesce({D.get_str('rec', 'error')}, '')) like '%quota%' then 'rate_limit'
       when lower(coalesce({D.get_str('rec', 'error')}, '')) like '%401%' or lower(coalesce({D.get_str('rec', 'error')}, '')) like '%unauthorized%' then 'auth'
       else 'unexpected' end as hint
from p where status = 'failed'""")
def failure_hints(spark, sf_dir):
    return L.failure_hints(parsed_labels(spark, sf_dir))


@register("unlabeled_files", duckdb_cte("label_log", "image_info") + ", p as (" + D.parsed("label_log") + ")" + """
select i.file_id, i.filename from image_info i
where not exists (select 1 from p where p.status = 'ok' and p.rec ->> '$._metadata.image_path' = i.filename)""")
def unlabeled_files(spark, sf_dir):
    labeled = L.successful(parsed_labels(spark, sf_dir)).select(L.image_path(F.col("rec")).alias("filename"))
    files = fixture(spark, sf_dir, "image_info").select("file_id", "filename")
    return JN.unmatched(files, labeled, "filename")
