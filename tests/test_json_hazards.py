"""Presence vs null, strict parsing, reply extraction, number rendering."""

import json

from pyspark.sql import functions as F

from docsift.functions import json as J
from docsift.operators import labels as L


def _log(spark, lines):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line_no long, line string")


def test_error_key_with_null_value_is_failed(spark):
    p = L.parse_log(_log(spark, ['{"error": null, "a": 1}', '{"a": 1}']))
    assert [r.status for r in p.orderBy("line_no").collect()] == ["failed", "ok"]


def test_strict_parse_rejects_trailing_text_and_two_objects(spark):
    lines = ['{"a":1} junk', '{"a":1}{"b":2}', "", "   ", "[1]", "5", '{"a": "broken', '  {"a":1}  ']
    p = L.parse_log(_log(spark, lines)).orderBy("line_no").collect()
    assert [r.status for r in p] == ["invalid_json", "invalid_json", "blank", "blank",
                                     "not_object", "not_object", "invalid_json", "ok"]


def test_overview_empty_log_is_zero(spark):
    o = L.overview(L.parse_log(spark.createDataFrame([], "line_no long, line string"))).first()
    assert (o.total_records, o.successful, o.failed, o.success_pct) == (0, 0, 0, 0.0)


def test_all_failed_gives_zero_percent(spark):
    o = L.overview(L.parse_log(_log(spark, ['{"error":"fail"}'] * 3))).first()
    assert (o.total_records, o.successful, o.success_pct) == (3, 0, 0.0)


def test_histogram_missing_and_null_buckets(spark):
    lines = ['{"document_category":"id"}', '{"document_category":null}', '{}', '{"document_category":"id"}']
    h = L.histograms(L.parse_log(_log(spark, lines)), fields=("document_category",)).collect()
    got = {r.value: (r.n, r.rank) for r in h}
    assert got == {"id": (2, 1), "None": (1, 2), "Unknown": (1, 3)}


def test_completeness_counts_empty_values(spark):
    lines = ['{"sensitive_data_types": [], "document_category": ""}', '{"sensitive_data_types": null}']
    g = {r.field: r.present for r in L.field_completeness(L.parse_log(_log(spark, lines))).collect()}
    assert g["sensitive_data_types"] == 1 and g["document_category"] == 1


def test_grades(spark):
    # 10 records: category present in 9 (90 %, required -> ok), scenarios in 10 (important -> warn)
    recs = [{"document_category": "x", "testing_scenarios": []} for _ in range(9)] + [{"testing_scenarios": []}]
    g = {r.field: r.grade for r in L.field_completeness(L.parse_log(_log(spark, [json.dumps(r) for r in recs]))).collect()}
    assert g["document_category"] == "✅"
    assert g["testing_scenarios"] == "⚠️"
    assert g["challenge_factors"] == "❌"


# reply -> the JSON text that is taken from it, case by case
REPLIES = [
    ('{"a":1}', '{"a":1}'),
    ('Here: {"a":1} done', '{"a":1}'),
    ('```json {"a":1} ``` tail', '{"a":1}'),
    ('```json{"a":1}', '{"a":1'),  # no closing fence: the last character is lost
    ('no json', 'no json'),
    ('{"a":1}{"b":2}', '{"a":1}{"b":2}'),
    ('', ''),
    ('} before {', ''),
    ('```json\n{"a": 2}\n```', '{"a": 2}'),
    ('x ```json```', ''),
]


def test_reply_json_text_case_by_case(spark):
    df = spark.createDataFrame(REPLIES, "reply string, want string")
    for r in df.select("reply", "want", J.reply_json_text(F.col("reply")).alias("got")).collect():
        assert r.got == r.want, r.reply


def test_verdicts_on_odd_lines(spark):
    lines = ['{"a":1}] junk', '{"a":1}] {"b":2}', '{"a":1}} x', '{"a":NaN,"b":[-Infinity, "NaN"]}', '{"a":"x NaN","b":Infinity}', '{"a":1,"a":2}',
             '{"a":[1,{"b":[2]}]}', '[1]] x', '{"a":NaN', '{"a":1},"w":{"b":2}']
    rows = L.parse_log(_log(spark, lines)).orderBy("line_no").select(
        "status", J.get_str(F.col("rec"), "a").alias("a"), J.get_double(F.col("rec"), "b").alias("b")).collect()
    assert [r.status for r in rows] == ["invalid_json"] * 3 + ["ok"] * 4 + ["invalid_json"] * 3
    assert (rows[3].a, rows[4].a, rows[4].b, rows[5].a) == ("NaN", "x NaN", float("inf"), "2")


def test_scalar_text_renders_fractions_as_floats(spark):
    df = spark.createDataFrame([('{"a": 462645.00, "b": 5, "c": "0.95", "d": 0.5}',)], "j string")
    v = J.strict_parse(F.col("j"))
    r = df.select(*[J.scalar_text(v, k).alias(k) for k in "abcd"]).first()
    assert (r.a, r.b, r.c, r.d) == ("462645.0", "5", "0.95", "0.5")


def test_a_line_is_parsed_once_and_marks_do_not_pass(spark):
    import io
    from contextlib import redirect_stdout

    a, b = J.MARKS
    lines = [f'{{"a":1}},{a}]', f'{{"a":1}}, {a}], {b}', f'{{"a":{a}}}', f'{{"a":[{a},{b}]}}', '{"a":1}, 5', '{"a":1},', "1,2", '{"a":1}]', '{"a":1}] {"b":[2', "[1],[2]", '"]"', '{"k":"]"}']
    df = _log(spark, lines).select("line_no", J.strict_parse(F.col("line")).alias("v"))
    got = [r.t for r in df.orderBy("line_no").select(F.to_json("v").alias("t")).collect()]
    assert got == [None, None, f'{{"a":{a}}}', f'{{"a":[{a},{b}]}}', None, None, None, None, None, None, '"]"', '{"k":"]"}']
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("extended")
    assert text.getvalue().split("== Optimized")[1].split("== Physical")[0].count("parseJson") == 1
