"""Queries over the invoice extraction log."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators import extraction as X
from docsift.operators import joins as JN
from docsift.operators import labels as L
from docsift.plans import duck as D
from docsift.plans.registry import register
from docsift.sources.fixtures import duckdb_cte, fixture


def parsed_extraction(spark, sf_dir):
    return L.parse_log(fixture(spark, sf_dir, "extraction_log"))


_P = duckdb_cte("extraction_log") + ", p as (" + D.parsed("extraction_log") + ")\n"
_S = _P + ", s as (select * from p where status = 'ok')\n"


@register("extraction_overview", _P + f"""
select count(*) as lines, count(*) filter (where rec is not null) as total_records,
  count(*) filter (where status = 'ok') as successful, count(*) filter (where status = 'failed') as failed,
  count(*) filter (where rec is null) as parse_errors,
  coalesce({D.pct("count(*) filter (where status = 'ok')", "count(*) filter (where rec is not null)")}, 0.0) as success_pct
from p""")
def extraction_overview(spark, sf_dir):
    return X.overview(parsed_extraction(spark, sf_dir))


_req_sum = " + ".join(f"cast({D.nonnull('rec', f)} as integer)" for f in C.REQUIRED_EXTRACTION_FIELDS)
_opt_sum = " + ".join(f"cast({D.nonnull('rec', f)} as integer)" for f in C.OPTIONAL_EXTRACTION_FIELDS)
_missing = ", ".join(f"case when not {D.nonnull('rec', f)} then '{f}' end" for f in C.REQUIRED_EXTRACTION_FIELDS)


@register("extraction_presence", _P + f"""
select line_no, status,
  case when status = 'ok' then rec ->> '$._metadata.image_path' end as image_path,
  case when status = 'ok' then {_req_sum} end as required_present,
  case when status = 'ok' then {_opt_sum} end as optional_present,
  case when status = 'ok' then array_to_string(list_filter([{_missing}], lambda x: x is not null), ', ') end as missing_required
from p""")
def extraction_presence(spark, sf_dir):
    return X.field_presence(parsed_extraction(spark, sf_dir))


_key_long = "\n union all ".join(
    f"select line_no, {i} as key_order, '{f}' as key, case when {D.nonnull('rec', f)} then {D.get_str('rec', f)} end as value from s"
    for i, f in enumerate(C.KEY_INFO_FIELDS))


@register("key_info", _S + f"""
select line_no, key_order, key, value from ({_key_long}) where value is not null""")
def key_info(spark, sf_dir):
    return X.key_info(parsed_extraction(spark, sf_dir))


@register("token_totals", _S + """
select count(*) as records,
  cast(sum(try_cast(rec ->> '$._metadata.api_response_tokens.prompt_tokens' as bigint)) as bigint) as prompt_tokens,
  cast(sum(try_cast(rec ->> '$._metadata.api_response_tokens.completion_tokens' as bigint)) as bigint) as completion_tokens,
  cast(sum(coalesce(try_cast(rec ->> '$._metadata.api_response_tokens.prompt_tokens' as bigint), 0)
         + coalesce(try_cast(rec ->> '$._metadata.api_response_tokens.completion_tokens' as bigint), 0)) as bigint) as total_tokens
from s""")
def token_totals(spark, sf_dir):
    return X.token_totals(parsed_extraction(spark, sf_dir))


@register("quality_flags", _S + """
select line_no,
  coalesce(json_type(rec, '$.total_amount') in ('UBIGINT', 'BIGINT', 'DOUBLE'), false) as amount_is_number,
  coalesce(try_cast(rec ->> '$.confidence_score' as double) between 0.0 and 1.0, false) as confidence_ok,
  try_strptime(rec ->> '$.invoice_date', '%Y-%m-%d') is not null as date_ok,
  try_cast(rec ->> '$.total_amount' as decimal(18,2)) as total_amount
from s""")
def quality_flags(spark, sf_dir):
    return X.quality_flags(parsed_extraction(spark, sf_dir))


# both records side by side, joined on the image they are about
@register("compare_views", duckdb_cte("label_log", "extraction_log")
          + ", pl as (" + D.parsed("label_log") + "), px as (" + D.parsed("extraction_log") + ")" + """
select coalesce(a.image_path, b.image_path) as image_path, a.line_no as label_line, b.line_no as extraction_line,
  a.document_category, a.ocr_difficulty, b.document_type, b.total_amount,
  a.line_no is not null as has_label, b.line_no is not null as has_extraction
from (select line_no, rec ->> '$._metadata.image_path' as image_path, rec ->> '$.document_category' as document_category,
   rec ->> '$.ocr_difficulty' as ocr_difficulty from pl where status = 'ok') a
full outer join (select line_no, rec ->> '$._metadata.image_path' as image_path, rec ->> '$.document_type' as document_type,
   try_cast(rec ->> '$.total_amount' as decimal(18,2)) as total_amount from px where status = 'ok') b
  on a.image_path = b.image_path""")
def compare_views(spark, sf_dir):
    rec = F.col("rec")
    lab = L.successful(L.parse_log(fixture(spark, sf_dir, "label_log"))).select(
        L.image_path(rec).alias("image_path"), F.col("line_no").alias("label_line"),
        J.get_str(rec, "document_category").alias("document_category"), J.get_str(rec, "ocr_difficulty").alias("ocr_difficulty"))
    ext = L.successful(parsed_extraction(spark, sf_dir)).select(
        L.image_path(rec).alias("image_path"), F.col("line_no").alias("extraction_line"),
        J.get_str(rec, "document_type").alias("document_type"), F.try_variant_get(rec, "$.total_amount", "decimal(18,2)").alias("total_amount"))
    return JN.side_by_side(lab, ext, "image_path", "has_label", "has_extraction")
