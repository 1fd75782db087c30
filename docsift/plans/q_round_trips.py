"""Sinks and sources as round trips on table-derived data: what is written is
read back, and the query returns what was read. Also service calls, requests,
image headers and full records."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators import labels as L
from docsift.operators import replies as R
from docsift.operators.requests import EXTRACT_PARAMS, LABEL_PARAMS, request_body
from docsift.operators.service import resolve_attempts
from docsift.plans import duck as D
from docsift.plans.q_extraction import parsed_extraction
from docsift.plans.q_labels import _P, _S, _hist_long, parsed_labels
from docsift.plans.q_replies import _J, _OBJ
from docsift.plans.registry import register
from docsift.session import scratch_dir, write_table
from docsift.sinks import writers as W
from docsift.sources import files as FS
from docsift.sources import images as IM
from docsift.sources.fixtures import duckdb_cte, fixture
from docsift.sources.image_folder import write_files
from docsift.sources.tables import table


@register("log_round_trip", _P + f"""
select {D.bucket('rec', 'document_category')} as category, status, count(*) as n from p where rec is not null group by 1, 2""")
def log_round_trip(spark, sf_dir):
    path = scratch_dir(spark, "round-trip-log")
    W.write_jsonl(L.records(parsed_labels(spark, sf_dir)), path, rec_col="rec")
    again = L.parse_log(FS.read_lines(spark, path))
    return again.groupBy(J.bucket_value(F.col("rec"), "document_category").alias("category"), "status").agg(F.count(F.lit(1)).alias("n"))


@register("url_list_round_trip", "select row_number() over (order by page_id) - 1 as ord, url from pages")
def url_list_round_trip(spark, sf_dir):
    path = scratch_dir(spark, "round-trip-urls")
    padded = F.concat(F.lit("\t "), F.col("url"), F.lit(" \r"))
    W.write_url_list(table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), padded.alias("url")), path)
    return FS.read_url_list(spark, path)


@register("store_round_trip", duckdb_cte("fingerprints") + """
select bits, concat('f', min(ord)) as file, min(ord) as ord, cast(min(block) as bigint) as batch_id from fingerprints group by bits""")
def store_round_trip(spark, sf_dir):
    path = scratch_dir(spark, "round-trip-store")
    fp = fixture(spark, sf_dir, "fingerprints")
    first = fp.groupBy("bits").agg(F.min("ord").alias("ord"), F.min("block").alias("block"))
    rows = write_table(first.select("bits", "ord", "block", F.conv("bits", 2, -10).cast("bigint").alias("hash"),
                                    F.concat(F.lit("f"), F.col("ord").cast("string")).alias("file")), "round-trip-rows")
    for block in (0, 1, 2, 2):  # a batch that is replayed replaces its own rows alone
        W.append_store(rows.filter(F.col("block") == block), path, block)
    return FS.read_store(spark, path).select("bits", "file", "ord", "batch_id")


_TITLES = "\n union all ".join(f"select {i + 1}, 0, 0, '{t}' union all select {i + 1}, 2147483647, 0, ''" for i, t in enumerate(C.REPORT_TITLES.values()))
_SECTION = " ".join(f"when '{d}' then {i + 1}" for i, d in enumerate(C.REPORT_TITLES))


@register("summary_report", _S + f""", l as ({_hist_long}),
 c as (select dimension, value, count(*) as n, min(line_no) as first_line from l group by dimension, value),
 h as (select *, n / sum(n) over (partition by dimension) * 100.0 as pct, row_number() over (partition by dimension order by n desc, first_line) as rank from c),
 o as (select count(*) as total, count(*) filter (where status = 'ok') as good from p where rec is not null),
 x(sec, rank, sub, line) as (
  select 0, 0, 0, '{C.REPORT_HEADING}' union all select 0, 0, 1, '{C.REPORT_RULE}' union all select 0, 0, 2, '' union all select 0, 0, 3, '{C.REPORT_OVERVIEW}'
  union all select 0, 0, 4, '{C.REPORT_TOTAL}' || total from o union all select 0, 0, 5, '{C.REPORT_SUCCESSFUL}' || good from o
  union all select 0, 0, 6, '{C.REPORT_FAILED}' || (total - good) from o
  union all select 0, 0, 7, '{C.REPORT_RATE}' || printf('%.1f', round_even(good / total * 100.0, 1)) || '%' from o union all select 0, 0, 8, ''
  union all {_TITLES}
  union all select case dimension {_SECTION} end, rank, 0, '- ' || value || ': ' || n || ' (' || printf('%.1f', round_even(pct, 1)) || '%)' from h)
select cast(row_number() over (order by sec, rank, sub) as bigint) as seq, line from x""")
def summary_report(spark, sf_dir):
    return W.summary_lines(parsed_labels(spark, sf_dir))


@register("comparison_document", duckdb_cte("label_log", "extraction_log")
          + ", pl as (" + D.parsed("label_log") + "), px as (" + D.parsed("extraction_log") + ")" + f"""
select a.rec ->> '$._metadata.image_path' as image_path, b.rec ->> '$.document_type' as document_type,
  a.rec ->> '$.ocr_difficulty' as ocr_difficulty, '{C.COMPARISON_SUMMARY["labeling_focus"]}' as labeling_focus
from pl a join px b on a.status = 'ok' and b.status = 'ok' and a.rec ->> '$._metadata.image_path' = b.rec ->> '$._metadata.image_path'""")
def comparison_document(spark, sf_dir):
    path = scratch_dir(spark, "round-trip-comparison")
    rec = F.col("rec")
    lab = L.successful(parsed_labels(spark, sf_dir)).select(L.image_path(rec).alias("image_path"), rec.alias("image_labeling"))
    ext = L.successful(parsed_extraction(spark, sf_dir)).select(L.image_path(rec).alias("image_path"), rec.alias("content_extraction"))
    W.write_comparison(lab.join(ext, "image_path"), path)
    doc = J.strict_parse(F.col("value"))
    back = spark.read.text(path).select(F.inline(F.array(F.struct(doc.alias("d")))))
    return back.select(J.get_str(F.col("d"), "image_path").alias("image_path"), J.get_str(F.col("d"), "content_extraction.document_type").alias("document_type"),
                       J.get_str(F.col("d"), "image_labeling.ocr_difficulty").alias("ocr_difficulty"),
                       J.get_str(F.col("d"), "comparison_summary.labeling_focus").alias("labeling_focus"))


@register("dataset_layout", duckdb_cte("label_log", "image_info") + ", p as (" + D.parsed("label_log") + ")" + f""",
 s as (select * from p where status = 'ok'), l as ({_hist_long})
select 'images' as part, count(*) as n from image_info union all select 'labels', count(*) from p where rec is not null
union all select 'summary', 15 + count(*) from (select distinct dimension, value from l)""")
def dataset_layout(spark, sf_dir):
    parsed = write_table(parsed_labels(spark, sf_dir).select("line_no", "line"), "round-trip-parsed")
    parsed = L.parse_log(parsed)
    parts = W.write_dataset(scratch_dir(spark, "round-trip-dataset"), images=fixture(spark, sf_dir, "image_info"),
                            labels=L.records(parsed), parsed_for_summary=parsed)
    out = None
    for name, path in parts.items():
        read = spark.read.parquet(path) if name == "images" else spark.read.text(path)
        one = read.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("step_status", """
with e as (select event_type as step, max_by(case when value >= 20 then 'success' else 'failed' end, event_id) as status from events group by 1)
select step, status, (select bool_and(status = 'success') from e) as all_ok from e""")
def step_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    steps = events.select(F.col("event_type").alias("step"), F.when(F.col("value") >= 20, F.lit("success")).otherwise(F.lit("failed")).alias("status"), "event_id")
    path = scratch_dir(spark, "round-trip-steps")
    W.write_step_status(steps, path, order="event_id")
    back = spark.read.schema("steps map<string,string>, all_ok boolean").json(path)
    return back.select(F.explode("steps").alias("step", "status"), "all_ok")


PROMPT, MODEL = "Describe the document.", "vision-model"


def _request_sql(params) -> str:
    """The request of one flavour, written out."""
    return f"""'{{"model":"{MODEL}","messages":[{{"role":"user","content":[{{"type":"text","text":"{PROMPT}"}},{{"type":"image_url","image_url":{{"url":"{C.DATA_URL_PREFIX}'
  || base64(encode(coalesce(text, ''))) || '","detail":"{params["detail"]}"}}}}]}}],"max_tokens":{params["max_tokens"]},"temperature":{params["temperature"]}}}'"""


_FLAVOURS = {"label": LABEL_PARAMS, "extract": EXTRACT_PARAMS}


@register("request_json", " union all ".join(f"select doc_id, '{name}' as flavour, md5({_request_sql(p)}) as request_md5 from documents" for name, p in _FLAVOURS.items()))
def request_json(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    each = [F.struct(F.lit(name).alias("flavour"), F.md5(request_body(content, PROMPT, MODEL, p)).alias("request_md5")) for name, p in _FLAVOURS.items()]
    return docs.select("doc_id", F.inline(F.array(*each)))


@register("display_values", _P + "select line_no" + "".join(
    f", case when {D.has('rec', f)} then {D.get_str('rec', f)} else 'N/A' end as \"{f}\"" for f in ("document_category", "ocr_difficulty", "text_clarity"))
    + " from p where rec is not null")
def display_values(spark, sf_dir):
    recs = L.records(parsed_labels(spark, sf_dir))
    return recs.select("line_no", *[J.display_value(F.col("rec"), f).alias(f) for f in ("document_category", "ocr_difficulty", "text_clarity")])


@register("service_calls", duckdb_cte("attempt_log") + """,
 t as (select * from attempt_log where attempt <= 3),
 a as (select url, min(attempt) filter (where exception_kind is null) as ok, max(attempt) as last from t group by url)
select a.url, case when ok is not null then t.status_code end as status_code, case when ok is null then t.exception_kind end as exception_kind, t.attempt as attempts
from a join t on t.url = a.url and t.attempt = coalesce(ok, last)""")
def service_calls(spark, sf_dir):
    return resolve_attempts(fixture(spark, sf_dir, "attempt_log"), "url")


def _number(n, size: int, big: bool = False):
    """Hex of ``n`` in ``size`` bytes."""
    places = range(size - 1, -1, -1) if big else range(size)
    return F.concat(*[F.lpad(F.hex(F.floor(n / 256 ** i) % 256), 2, "0") for i in places])


#: Formats that the written headers take in turn.
_FORMATS = ("BMP", "PNG", "GIF", "JPEG", "WEBP")


@register("image_headers", duckdb_cte("image_info") + f""",
 f as (select *, [{', '.join(f"'{x}'" for x in _FORMATS)}][1 + file_id % {len(_FORMATS)}] as kind from image_info)
select file_id, case when decodable then kind end as format, case when decodable then width end as width, case when decodable then height end as height,
  case when decodable then case when kind = 'GIF' then 'P' when kind <> 'JPEG' and mode = 'RGBA' then 'RGBA' else 'RGB' end end as mode,
  decodable and kind in ('PNG', 'GIF') and file_id % 2 = 0 as transparency,
  case when not decodable then 'cannot identify image file' end as error from f""")
def image_headers(spark, sf_dir):
    """Headers of all five formats: PNG with and without tRNS, GIF with a comment
    before the graphic control extension, JPEG whose frame header follows a long
    APP segment full of markers, WebP in the extended layout."""
    info = fixture(spark, sf_dir, "image_info")
    w, h, rgba, marked = F.col("width"), F.col("height"), F.col("mode") == "RGBA", F.col("file_id") % 2 == 0

    def either(condition, yes: str, no: str):
        return F.when(condition, F.lit(yes)).otherwise(F.lit(no))

    def text(x: str):
        return F.lit(x.encode().hex())

    zeros = F.lit("00" * 4)
    png = F.concat(F.lit("89504E470D0A1A0A"), F.lit("0000000D"), text("IHDR"), _number(w, 4, True), _number(h, 4, True), F.lit("08"),
                   either(rgba, "06", "02"), F.lit("000000"), zeros, F.when(marked, F.concat(F.lit("00000006"), text("tRNS"), F.lit("00" * 6), zeros)).otherwise(F.lit("")),
                   zeros, text("IDAT"), zeros)
    gif = F.concat(text("GIF89a"), _number(w, 2), _number(h, 2), F.lit("000000"), F.lit("21FE0361626300"),
                   F.lit("21F904"), either(marked, "01", "00"), F.lit("00000000"), F.lit("2C"))
    jpeg = F.concat(F.lit("FFD8FFE11000"), F.lit("FFC0" * 2047), F.lit("FFC0001108"), _number(h, 2, True), _number(w, 2, True), F.lit("03"), zeros)
    webp = F.concat(text("RIFF"), zeros, text("WEBPVP8X"), F.lit("0A000000"), either(rgba, "10", "00"), F.lit("000000"), _number(w - 1, 3), _number(h - 1, 3))
    bmp = F.concat(text("BM"), F.lit("00" * 16), _number(w, 4), _number(h, 4), F.lit("0100"), either(rgba, "2000", "1800"))
    written = F.element_at(F.array(bmp, png, gif, jpeg, webp), (F.col("file_id") % len(_FORMATS) + 1).cast("int"))
    header = F.unhex(F.when(F.col("decodable"), written).otherwise(F.lit("00" * 30)))
    return info.select("file_id", IM.header_info(header).alias("h")).select(
        "file_id", "h.format", F.col("h.width").cast("bigint").alias("width"), F.col("h.height").cast("bigint").alias("height"), "h.mode", "h.transparency", "h.error")


@register("label_records", _J + f""", e as (select *, case
  when exception_kind = 'timeout' then '{C.ERR_TIMEOUT}'
  when exception_kind is not null then '{C.ERR_OTHER_PREFIX}' || exception_kind
  when status_code <> 200 then '{C.ERR_STATUS_PREFIX}' || cast(status_code as varchar)
  when not coalesce(json_valid(json_text), false) then '{C.ERR_JSON}'
  when not {_OBJ} then '{C.ERR_OTHER_PREFIX}reply is not a JSON object' end as error from j)
select conv_id, turn, error, case when error is null then json_text ->> '$.summary' end as summary,
  case when error = '{C.ERR_JSON}' then json_text end as raw_response, case when error = '{C.ERR_JSON}' then '{R.JSON_ERROR}' end as json_error,
  case when exception_kind is null and status_code <> 200 then content end as error_details,
  concat('img/', conv_id, '_', turn, '.png') as image_path, case when error is null then '2024-01-01T00:00:00' end as classification_timestamp,
  case when error is null then '{MODEL}' end as model_used, case when error is null then '{C.METADATA_PURPOSE}' end as purpose,
  concat(conv_id, '_', turn, '.png') as filename, cast(row_number() over (order by conv_id, turn) as varchar) as processing_order from e""")
def label_records(spark, sf_dir):
    from docsift.operators.numbering import with_position

    J.allow_repeated_keys(spark)
    replies = with_position(fixture(spark, sf_dir, "model_replies"), ["conv_id", "turn"], "nth", start=1)
    path = F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".png"))
    out = R.with_metadata(R.with_outcome(replies), path, None, F.lit("2024-01-01T00:00:00"), MODEL)
    return record_fields(R.record_text(R.with_file_info(out, path, F.col("nth"))), "line")


def record_fields(lines, line: str):
    """The fields of label records, read back from their JSON lines."""
    rec = F.col("rec")
    parsed = lines.select("conv_id", "turn", F.inline(F.array(F.struct(J.parse_object(F.col(line)).alias("rec")))))
    own = [J.get_str(rec, k).alias(k) for k in ("error", "summary", "raw_response", "json_error", "error_details")]
    meta = [J.get_str(rec, f"_metadata.{k}").alias(k) for k in ("image_path", "classification_timestamp", "model_used", "purpose")]
    info = [J.get_str(rec, f"_file_info.{k}").alias(k) for k in ("filename", "processing_order")]
    return parsed.select("conv_id", "turn", *own, *meta, *info)


#: Suffixes and first characters that the scanned files take in turn.
_SUFFIXES = (".jpg", ".JPG", ".Jpg", ".jpeg", ".png", ".PNG", ".webp", ".bmp", ".tiff", ".tif", ".txt", "")
_FIRSTS = ("_", ".", "a", "=", " ")


@register("image_scans", f"""
with f as (select [{', '.join(f"'{x}'" for x in _FIRSTS)}][1 + doc_id % {len(_FIRSTS)}] || 'doc%20' || doc_id || s as name, s, strlen(coalesce(text, '')) as length
  from (select *, [{', '.join(f"'{x}'" for x in _SUFFIXES)}][1 + doc_id % {len(_SUFFIXES)}] as s from documents)),
 x as (select 'label' as flavour, 0 as rank, * from f where lower(s) in ({', '.join(f"'{x}'" for x in C.LABEL_SCAN_SUFFIXES)})
  union all select 'extract', list_position(['.jpg', '.jpeg', '.png', '.webp'], s), * from f where s in ('.jpg', '.jpeg', '.png', '.webp')
  union all select 'dedup', 0, * from f where s in ('.jpg', '.jpeg', '.png', '.webp', '.JPG', '.JPEG', '.PNG', '.WEBP'))
select flavour, name, length, row_number() over (partition by flavour order by rank, name) as processing_order from x""")
def image_scans(spark, sf_dir):
    def pick(values):
        return F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values)).cast("int"))

    docs = table(spark, sf_dir, "documents")
    name = F.concat(pick(_FIRSTS), F.lit("doc%20"), F.col("doc_id").cast("string"), pick(_SUFFIXES))
    folder = scratch_dir(spark, "image-scans")
    write_files(docs.select(name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), folder)
    out = None
    for flavour in ("label", "extract", "dedup"):
        one = FS.number_files(FS.scan_images(spark, folder, flavour), flavour).select(F.lit(flavour).alias("flavour"), "name", "length", "processing_order")
        out = one if out is None else out.unionByName(one)
    return out
