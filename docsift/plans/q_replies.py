"""Queries over stored model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators import replies as R
from docsift.plans.registry import register
from docsift.sources.fixtures import duckdb_cte, fixture

_BS = "(strpos(content, '```json') + 7)"
_REL = f"strpos(substring(content, {_BS}), '```')"
_FENCED = (f"regexp_replace(substring(content, {_BS}, greatest(case when {_REL} > 0 then {_REL} - 1 "
           f"else length(content) - {_BS} end, 0)), '^\\s+|\\s+$', '', 'g')")
_LAST = "case when strpos(content, '}') > 0 then length(content) - strpos(reverse(content), '}') + 1 else 0 end"
_FIRST = "strpos(content, '{')"
_TEXT = f"""case when strpos(content, '```json') > 0 then {_FENCED}
  when {_FIRST} > 0 then case when {_LAST} >= {_FIRST} then substring(content, {_FIRST}, {_LAST} - {_FIRST} + 1) else '' end
  else content end"""
_J = duckdb_cte("model_replies") + f", j as (select *, {_TEXT} as json_text from model_replies)\n"


@register("reply_json", _J + "select conv_id, turn, json_text, coalesce(json_valid(json_text), false) as parses from j")
def reply_json(spark, sf_dir):
    r = fixture(spark, sf_dir, "model_replies")
    text = J.reply_json_text(F.coalesce(F.col("content"), F.lit("")))
    return r.select("conv_id", "turn", text.alias("json_text"), J.strict_parse(text).isNotNull().alias("parses"))


_OBJ = "coalesce(case when json_valid(json_text) then json_type(json_text) = 'OBJECT' end, false)"


@register("label_outcomes", _J + f""", e as (select *, case
  when exception_kind = 'timeout' then '{C.ERR_TIMEOUT}'
  when exception_kind = 'network' then '{C.ERR_NETWORK_PREFIX}' || exception_kind
  when exception_kind is not null then '{C.ERR_OTHER_PREFIX}' || exception_kind
  when status_code <> 200 then '{C.ERR_STATUS_PREFIX}' || cast(status_code as varchar)
  when not coalesce(json_valid(json_text), false) then '{C.ERR_JSON}'
  when not {_OBJ} then '{C.ERR_OTHER_PREFIX}reply is not a JSON object' end as error from j)
select conv_id, turn, case when error is null then 'ok' else 'error' end as outcome, error,
  case when error is null then json_text ->> '$.document_category' end as document_category from e""")
def label_outcomes(spark, sf_dir):
    o = R.with_outcome(fixture(spark, sf_dir, "model_replies"))
    return o.select("conv_id", "turn",
                    F.when(F.col("o.has_error"), F.lit("error")).otherwise(F.lit("ok")).alias("outcome"),
                    F.col("o.error").alias("error"),
                    J.get_str(F.col("o.rec"), "document_category").alias("document_category"))


@register("extraction_outcomes", _J + f""", e as (select *, case
  when exception_kind is not null then '{C.ERR_OTHER_PREFIX}' || exception_kind
  when status_code <> 200 then '{C.ERR_STATUS_PREFIX}' || cast(status_code as varchar)
  when not coalesce(json_valid(json_text), false) then '{C.ERR_JSON}'
  when not {_OBJ} then '{C.ERR_OTHER_PREFIX}reply is not a JSON object' end as error from j)
select error, count(*) as n from e group by error""")
def extraction_outcomes(spark, sf_dir):
    o = R.with_outcome(fixture(spark, sf_dir, "model_replies"), flavour="extraction")
    return o.groupBy(F.col("o.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))
