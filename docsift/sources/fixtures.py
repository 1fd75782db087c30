"""Derived inputs built from the driver tables (see FIXTURES.md section 2).

Each input is one SELECT over the driver's parquet tables. The same text runs
on Spark SQL and on DuckDB, so the oracle queries can embed it as a CTE and
both engines start from identical rows. Only ``fingerprints`` needs one form
per engine (lambda syntax differs).

The derived inputs stand in for the artefacts the labeling workflow produces
(label logs, extraction logs, stored search responses, fetch logs, model
replies, perceptual hashes). Their size grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.sources.tables import sql_over

# lines that hold a record carry its image path; the others are the readings a
# tolerant reader must get right (broken, blank, trailing text, NaN, repeated keys)
LABEL_LOG = """
with n as (select d.*, l.quality, l.toxic, concat('image_', lpad(cast(d.doc_id as varchar(20)), cast(greatest(6, length(cast(d.doc_id as varchar(20)))) as integer), '0'), case d.doc_id % 3 when 0 then '.jpg' when 1 then '.PNG' else '.webp' end) as image_path
  from documents d left join labels l on d.doc_id = l.doc_id),
 m as (select *, concat(',"_metadata":{"image_path":"', image_path, '"},"_file_info":{"filename":"', image_path, '","processing_order":', cast(doc_id + 1 as varchar(20)), '}') as tail from n)
select doc_id + 1 as line_no,
 case when doc_id % 97 = 13 then '{"document_category": "broken'
      when doc_id % 89 = 7 then ''
      when doc_id % 83 = 5 then concat('{"document_category":"', source, '"} trailing')
      when doc_id % 83 = 6 then concat('{"document_category":"', source, '"}] junk')
      when doc_id % 83 = 7 then concat('{"document_category":"', source, '"}] {"a":1}')
      when doc_id % 79 = 3 then concat('{"document_category":"', source, '","error":null', tail, '}')
      when doc_id % 79 = 4 then concat('{"document_category":"', source, '","document_category":"', source, '"', tail, '}')
      when doc_id % 79 = 5 then concat('{"document_category":"', source, '","text_clarity":NaN', tail, '}')
      when quality is null then concat('{"error":"', case doc_id % 4 when 0 then 'API request timed out' when 1 then 'HTTP 429 quota' when 2 then 'HTTP 401 unauthorized' else 'Network error' end, '"', tail, '}')
      else concat('{', case when doc_id % 13 = 0 then '' when doc_id % 17 = 0 then '"document_category":null,' else concat('"document_category":"', source, '",') end,
        '"document_subcategory":"', case when toxic = 1 then 'toxic' else 'plain' end, '","language_primary":"', lang,
        '","text_clarity":', case when doc_id % 19 = 0 then 'null' else '"clear"' end,
        ',"image_quality":"', case when quality = 1 then 'high' else 'low' end,
        '","ocr_difficulty":"', case when n_chars < 300 then 'easy' when n_chars < 1500 then 'medium' when n_chars < 6000 then 'hard' else 'very_hard' end,
        '","sensitive_data_types":', case when text like '%@%' then '["email","name"]' when doc_id % 5 = 0 then '[]' else 'null' end,
        case when doc_id % 3 = 0 then ',"testing_scenarios":["identity_verification","financial_audit","compliance_check","data_extraction"]' else '' end,
        ',"confidence_score":', case when doc_id % 2 = 0 then concat('"0.', cast(doc_id % 90 + 10 as varchar(20)), '"') else concat('0.', cast(doc_id % 90 + 10 as varchar(20))) end, tail, '}') end as line
 from m
"""

IMAGE_INFO = """
select doc_id as file_id, concat('image_', lpad(cast(doc_id as varchar(20)), cast(greatest(6, length(cast(doc_id as varchar(20)))) as integer), '0'), case doc_id % 3 when 0 then '.jpg' when 1 then '.PNG' else '.webp' end) as filename,
  n_chars * 40 as file_size, 50 + (doc_id * 37) % 4600 as width, 50 + (doc_id * 91) % 4600 as height,
  case doc_id % 8 when 0 then 'GIF' when 1 then 'PNG' when 2 then 'WEBP' when 3 then 'BMP' else 'JPEG' end as format,
  case doc_id % 5 when 0 then 'RGBA' when 1 then 'L' when 2 then 'LA' else 'RGB' end as mode, doc_id % 7 = 3 as transparency, doc_id % 23 <> 0 as decodable
 from documents
"""

# three pages make one response; the last group may have fewer, and then
# repeats its last page. 'kwfailed' is a keyword all of whose responses failed
SEARCH_RESPONSES = """
with p as (select cast(floor(page_id / 3) as bigint) as g, min(page_id) as page_id,
   max(case when page_id % 3 = 0 then url end) as a0, max(case when page_id % 3 = 1 then url end) as a1, max(case when page_id % 3 = 2 then url end) as a2,
   sum(length(html)) as n_html from pages group by cast(floor(page_id / 3) as bigint)),
 g as (select g, page_id, n_html, coalesce(a0, a1, a2) as u0, coalesce(a1, a0, a2) as u1, coalesce(a2, a1, a0) as u2 from p)
 select g as response_id, case when g % 22 = 10 then 'kwfailed' else concat('kw', cast(g % 5 as varchar(20))) end as keyword,
  case g % 4 when 0 then 'serper' when 1 then 'unsplash' when 2 then 'serpapi' else 'flickr' end as engine,
  case when g % 11 = 10 then 429 else 200 end as status_code,
  case g % 4 when 0 then concat('{"images":[{"imageUrl":"', u0, '","link":"x"},{"link":"', u1, '"},{"title":"none"},{"imageUrl":"', u2, '"}]}')
   when 1 then concat('{"results":[{"urls":{"regular":"', u0, '"}},{"urls":{"regular":"', u1, '"}},{"urls":{"regular":"', u0, '"}},{"urls":{"regular":"', u2, '"}}]}')
   when 2 then concat('{"images_results":[{"original":"', u0, '"},{"thumbnail":"', u1, '"},{"original":"', u1, '"},{"original":"', u2, '"}]}')
   else concat('{"photos":{"photo":[{"farm":', cast(g % 9 as varchar(20)), ',"server":"s', cast(g as varchar(20)), '","id":"', cast(page_id as varchar(20)), '","secret":"', cast(n_html as varchar(20)),
     '"},{"farm":1,"server":"s', cast(g as varchar(20)), '","id":"', cast(page_id + 1 as varchar(20)), '","secret":"z"},{"farm":2,"server":"s', cast(g as varchar(20)), '","id":"', cast(page_id + 2 as varchar(20)), '","secret":"z"}]}}') end as body
 from g
"""

FETCH_LOG = """
select page_id as ord, concat(url, case page_id % 7 when 0 then '/a/b.JPG?x=1.png' when 1 then '/.jpg' when 2 then '/a.b/c' when 3 then '/x.tar.webp#f' when 4 then '/y.gif' when 5 then '/z.jpeg' else '' end) as url,
  case page_id % 9 when 0 then 404 when 1 then 500 else 200 end as status_code,
  case page_id % 6 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/webp' when 3 then 'application/octet-stream' when 4 then '' else 'IMAGE/JPEG' end as content_type
 from pages
"""

ATTEMPT_LOG = """
select concat('http://u', cast(user_id as varchar(20)), '.example.com/', cast(cast(floor(event_id / 400) as int) as varchar(20))) as url,
  cast(row_number() over (partition by user_id, cast(floor(event_id / 400) as int) order by ts, event_id) as int) as attempt,
  case event_type when 'click' then 200 when 'view' then 500 when 'signup' then 404 else null end as status_code,
  case event_type when 'error' then 'timeout' when 'purchase' then 'network' else null end as exception_kind
 from events
"""

MODEL_REPLIES = """
with a as (select conv_id, turn, (conv_id + turn) % 8 as k, concat('{"document_category":"c', cast(conv_id % 6 as varchar(20)), '","n":', cast(turn as varchar(20)), ',"summary":"', replace(replace(replace(replace(replace(coalesce(text, ''), chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't')), chr(13), concat(chr(92), 'r')), '"}') as j from conversations where role = 'assistant')
 select conv_id, turn, case when k = 7 then 429 else 200 end as status_code, case when k = 6 then 'timeout' else null end as exception_kind,
  case k when 0 then j when 1 then concat('Here it is: ', j, ' Done.') when 2 then concat('```json ', j, ' ``` tail') when 3 then concat('```json', j) when 4 then 'no json here' when 5 then concat(j, j) else '' end as content
 from a
"""

# block 0: a first crawl; block 1: some of it with two bits changed; block 2:
# some of it again. ord = vector id * 3 + block
FINGERPRINTS_SPARK = """
with b as (select vec_id, transform(embedding, x -> cast(x as double)) e from embeddings),
 m as (select vec_id, e, aggregate(e, 0D, (a,x) -> a+x)/size(e) mu from b),
 h as (select vec_id ord, array_join(transform(e, x -> if(x>mu,'1','0')),'') bits from m)
select ord * 3 as ord, 0 as block, bits from h
union all select ord * 3 + 1, 1, concat(substring(bits, 1, cast(ord % 62 as int)), translate(substring(bits, cast(ord % 62 as int) + 1, 2), '01', '10'), substring(bits, cast(ord % 62 as int) + 3)) from h where ord % 3 = 0
union all select ord * 3 + 2, 2, bits from h where ord % 10 = 0
"""

FINGERPRINTS_DUCKDB = """
with b as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
 m as (select vec_id, e, list_sum(e)/len(e) mu from b),
 h as (select vec_id ord, array_to_string(list_transform(e, lambda x: case when x>mu then '1' else '0' end),'') bits from m)
select ord * 3 as ord, 0 as block, bits from h
union all select ord * 3 + 1, 1, concat(substring(bits, 1, cast(ord % 62 as int)), translate(substring(bits, cast(ord % 62 as int) + 1, 2), '01', '10'), substring(bits, cast(ord % 62 as int) + 3)) from h where ord % 3 = 0
union all select ord * 3 + 2, 2, bits from h where ord % 10 = 0
"""

EXTRACTION_LOG = """
select o_orderkey + 1 as line_no,
 case when o_orderkey % 101 = 9 then '{"document_type": "invoice"'
      when o_orderkey % 37 = 4 then '{"error":"API 500","error_details":"fail"}'
      else concat('{"document_type":', case when o_orderkey % 11 = 0 then 'null' else '"invoice"' end,
        ',"language":"English","currency":"', case when o_orderkey % 3 = 0 then 'INR' else 'USD' end,
        '","total_amount":', case when o_orderkey % 5 = 0 then concat('"', cast(cast(o_totalprice as decimal(18,2)) as varchar(30)), '"') else cast(cast(o_totalprice as decimal(18,2)) as varchar(30)) end,
        case when o_orderkey % 7 = 0 then '' else concat(',"vendor_name":"V', cast(o_custkey as varchar(20)), '"') end,
        ',"invoice_number":"INV-', cast(o_orderkey as varchar(20)), '","invoice_date":"', cast(cast(o_orderdate as date) as varchar(10)),
        '","items":[{"description":"d","quantity":"1","unit_price":1,"amount":1}],"tax_details":', case when o_orderkey % 2 = 0 then 'null' else '{"tax_rate":"18%"}' end,
        ',"confidence_score":', case when o_orderkey % 43 = 0 then '1.5' else '0.5' end,
        ',"_metadata":{"image_path":"image_', lpad(cast(o_orderkey as varchar(20)), cast(greatest(6, length(cast(o_orderkey as varchar(20)))) as integer), '0'), '.jpg","api_response_tokens":{"prompt_tokens":', cast(o_orderkey % 900 + 1000 as varchar(20)),
        ',"completion_tokens":', cast(o_orderkey % 90 + 100 as varchar(20)), '}}}') end as line
 from orders
"""

# name -> (spark text, duckdb text)
FIXTURES: dict[str, tuple[str, str]] = {
    "label_log": (LABEL_LOG, LABEL_LOG),
    "image_info": (IMAGE_INFO, IMAGE_INFO),
    "search_responses": (SEARCH_RESPONSES, SEARCH_RESPONSES),
    "fetch_log": (FETCH_LOG, FETCH_LOG),
    "attempt_log": (ATTEMPT_LOG, ATTEMPT_LOG),
    "model_replies": (MODEL_REPLIES, MODEL_REPLIES),
    "fingerprints": (FINGERPRINTS_SPARK, FINGERPRINTS_DUCKDB),
    "extraction_log": (EXTRACTION_LOG, EXTRACTION_LOG),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build one derived input as a lazy DataFrame over the tables in ``sf_dir``."""
    return sql_over(spark, sf_dir, FIXTURES[name][0])


def duckdb_cte(*names: str) -> str:
    """``WITH`` prefix declaring the named inputs for an oracle query."""
    return "with " + ",\n".join(f"{n} as ({FIXTURES[n][1]})" for n in names) + "\n"
