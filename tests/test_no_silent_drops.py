"""Whole files, whole listings, large ids, missing tables, store errors."""

import json
import os
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docsift.operators import replies as R
from docsift.plans import jobs
from docsift.sinks import writers as W
from docsift.sources import files as FS
from docsift.sources import images as IM
from docsift.sources.fixtures import fixture
from tests.test_jobs import noise_png


def jpeg(width, height, segments):
    body = b"".join(b"\xff\xe2" + struct.pack(">H", n + 2) + b"\x00" * n for n in segments)
    return b"\xff\xd8" + body + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\x00" * 20


def png(chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + b"0000" for k, d in chunks)


def test_headers_are_read_however_far_they_are():
    info = IM._header_info(jpeg(800, 600, [60_000, 60_000, 65_000]))
    assert (info["format"], info["width"], info["height"], info["mode"]) == ("JPEG", 800, 600, "RGB")
    head = struct.pack(">IIBBBBB", 7, 9, 8, 3, 0, 0, 0)
    marked = IM._header_info(png([(b"IHDR", head), (b"iCCP", b"x" * 90_000), (b"tRNS", b"\x00"), (b"IDAT", b"")]))
    assert marked["mode"] == "P" and marked["transparency"] is True
    plain = IM._header_info(png([(b"IHDR", head), (b"IDAT", b"tRNS"), (b"tRNS", b"\x00")]))
    assert plain["transparency"] is False
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 4, 0x80, 0, 0) + b"\x00" * 6
    assert IM._header_info(gif + b"\x21\xfe\x02hi\x00" + b"\x21\xf9\x04\x01\x00\x00\x00\x00\x2c")["transparency"] is True
    assert IM._header_info(gif + b"\x21\xf9\x04\x00\x00\x00\x00\x00\x2c")["transparency"] is False


def test_every_listed_file_gets_a_status_and_new_hashes_are_stored(spark, tmp_dir):
    folder, store = os.path.join(tmp_dir, "images"), os.path.join(tmp_dir, "store")
    os.makedirs(folder)
    webp = b"RIFF" + struct.pack("<I", 30) + b"WEBPVP8 " + b"\x00" * 10 + struct.pack("<HH", 400, 400) + b"\x00" * 6000
    files = {"a.png": noise_png(320, 320, 1), "w.webp": webp, "tiny.png": noise_png(20, 20, 2)[:900], "_x.png": noise_png(320, 320, 3), "big.jpg": b"\xff\xd8" + b"0" * 11_000_000}
    for name, data in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    got = {os.path.basename(r.path): r.status for r in jobs.accept_images(spark, folder, store).collect()}
    # one picture in two files: the name that starts with "_" comes first
    assert got == {"a.png": "duplicate", "w.webp": "accepted", "tiny.png": "invalid", "_x.png": "accepted", "big.jpg": "invalid"}
    assert FS.read_store(spark, store).count() == 1
    again = {os.path.basename(r.path): r.status for r in jobs.accept_images(spark, folder, store).collect()}
    assert again["a.png"] == again["_x.png"] == "duplicate" and FS.read_store(spark, store).count() == 1


def test_large_ids_keep_their_digits(spark, tmp_dir):
    docs = spark.createDataFrame([(i, "text", "en", "s", 300) for i in (7, 999_999, 1_234_567, 12_345_678)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    names = {r.filename.split(".")[0] for r in fixture(spark, tmp_dir, "image_info").collect()}
    assert names == {"image_000007", "image_999999", "image_1234567", "image_12345678"}
    emb = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(64)]) for i in (30, 1_000_020, 2_000_040)], "vec_id bigint, embedding array<double>")
    emb.write.parquet(os.path.join(tmp_dir, "embeddings.parquet"))
    rows = fixture(spark, tmp_dir, "fingerprints").collect()
    assert len({r.ord for r in rows}) == len(rows) == 9 and {r.ord % 3 for r in rows if r.block == 2} == {2}


def test_missing_table_raises_and_folders_do_not_mix(spark, tmp_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k in ("a", "b"):
        spark.createDataFrame([(1, "t", "en", k, 300)], schema).write.parquet(os.path.join(tmp_dir, k, "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(tmp_dir, "a", "labels.parquet"))
    assert fixture(spark, os.path.join(tmp_dir, "a"), "label_log").count() == 1
    with pytest.raises(AnalysisException):
        fixture(spark, os.path.join(tmp_dir, "b"), "label_log").count()


def test_users_views_are_left_alone(spark, tmp_dir):
    spark.range(3).createOrReplaceTempView("documents")
    spark.createDataFrame([(1, "t", "en", "s", 300)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    assert fixture(spark, tmp_dir, "image_info").count() == 1
    assert spark.table("documents").count() == 3
    spark.catalog.dropTempView("documents")


def test_only_a_missing_store_is_empty(spark, tmp_dir):
    assert FS.read_store(spark, os.path.join(tmp_dir, "none")).count() == 0
    bad = os.path.join(tmp_dir, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "wb") as f:
        f.write(b"not parquet at all")
    with pytest.raises(Exception):
        FS.read_store(spark, bad).collect()


@pytest.mark.parametrize("indent", [2, None])
def test_store_json_is_read_by_lines(spark, tmp_dir, indent):
    p = os.path.join(tmp_dir, f"store{indent}.json")
    want = {f"{k:016x}": f'dir/f "{k}", x.png' for k in (0, 5, 2**64 - 1)}
    with open(p, "w") as f:
        json.dump(want, f, indent=indent)
    got = {format(r.hash & (2**64 - 1), "016x"): r.file for r in FS.import_store_json(spark, p).collect()}
    assert got == want


def test_url_list_strips_all_white_space(spark, tmp_dir):
    p = os.path.join(tmp_dir, "urls.txt")
    with open(p, "w") as f:
        f.write("\thttp://a \n \t\nhttp://b\r\n")
    assert [r.url for r in FS.read_url_list(spark, p).orderBy("ord").collect()] == ["http://a", "http://b"]


def test_numbering_never_moves_image_bytes(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "n")
    os.makedirs(folder)
    for name in ("b.png", "a.jpg"):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(b"x" * 100)
    numbered = FS.number_files(FS.scan_images(spark, folder))
    assert "content" not in numbered.columns
    assert [os.path.basename(r.path) for r in numbered.orderBy("processing_order").collect()] == ["a.jpg", "b.png"]


def test_repeated_steps_count_with_their_last_status(spark):
    steps = spark.createDataFrame([("a", "failed", 1), ("a", "success", 2), ("b", "success", 1)], "step string, status string, n int")
    r = W.step_status(steps, "n").first()
    assert r.steps == {"a": "success", "b": "success"} and r.all_ok is True


def test_rows_that_fail_outside_the_call_are_records(spark):
    df = spark.createDataFrame([(None, "processing", "cannot open", None)], "status_code int, exception_kind string, exception_message string, content string")
    assert R.with_outcome(df).first().o.error == "Processing failed: cannot open"
    assert R.with_outcome(df, "extraction").first().o.error == "处理异常: cannot open"


def test_label_job_writes_log_and_summary(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "imgs")
    os.makedirs(folder)
    for i, data in enumerate([noise_png(64, 64, 1), noise_png(64, 64, 2), b"\x89PNG" + b"0" * (5 << 20)]):
        with open(os.path.join(folder, f"{i}.png"), "wb") as f:
            f.write(data)

    def client():
        return lambda request: (200, '{"document_category":"invoice"}')

    log, report = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "report")
    jobs.label(spark, folder, client, "p", "m", "2024-01-01T00:00:00", log_dir=log, summary_dir=report)
    records = [json.loads(r.value) for r in spark.read.text(log).collect()]
    assert [r["_file_info"]["processing_order"] for r in records] == [1, 2, 3]
    assert [r.get("document_category") for r in records] == ["invoice", "invoice", None]
    assert records[0]["_metadata"]["image_info"]["width"] == 64 and records[0]["_metadata"]["purpose"] == "OCR_DLP_performance_testing"
    assert records[2]["error"].startswith("Processing failed: ") and "model_used" not in records[2]["_metadata"]
    assert "- Total Images: 3" in [r.value for r in spark.read.text(report).collect()]
