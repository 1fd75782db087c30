"""Round trips through files: image folders, logs, URL lists, store, report."""

import json
import os
import struct
import zlib

from pyspark.sql import functions as F

from docsift.operators import labels as L
from docsift.sinks import writers as W
from docsift.sources import files as FS
from docsift.sources import images as IM


def png_bytes(w, h, rgb=(255, 0, 0), alpha=False):
    def chunk(kind, data):
        c = struct.pack(">I", len(data)) + kind + data
        return c + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)
    ctype = 6 if alpha else 2
    px = bytes(rgb) + (b"\xff" if alpha else b"")
    raw = b"".join(b"\x00" + px * w for _ in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def half_png(w, h):
    """Left half black, right half white (a non-flat image)."""
    def chunk(kind, data):
        c = struct.pack(">I", len(data)) + kind + data
        return c + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)
    row = b"\x00" + b"\x00\x00\x00" * (w // 2) + b"\xff\xff\xff" * (w - w // 2)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(row * h)) + chunk(b"IEND", b""))


def _folder(tmp_dir):
    d = os.path.join(tmp_dir, "imgs")
    os.makedirs(d)
    files = {"a.png": png_bytes(40, 30), "b.PNG": png_bytes(20, 10, alpha=True), "c.jpg": b"x" * 9000,
             "d.tiff": b"II*\x00" + b"0" * 100, "e.txt": b"hello", "f.Png": half_png(64, 64)}
    for n, b in files.items():
        with open(os.path.join(d, n), "wb") as f:
            f.write(b)
    return d


def test_scan_flavours(spark, tmp_dir):
    d = _folder(tmp_dir)
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(FS.scan_images(spark, d, "label")) == ["a.png", "b.PNG", "c.jpg", "d.tiff", "f.Png"]
    assert names(FS.scan_images(spark, d, "extract")) == ["a.png", "c.jpg"]
    assert names(FS.scan_images(spark, d, "dedup")) == ["a.png", "b.PNG", "c.jpg"]
    assert names(FS.scan_images(spark, d, "label", min_bytes=5000)) == ["c.jpg"]
    order = FS.number_files(FS.scan_images(spark, d, "extract"), "extract").orderBy("processing_order")
    assert [r.name for r in order.collect()] == ["c.jpg", "a.png"]


def test_header_info(spark, tmp_dir):
    d = _folder(tmp_dir)
    info = {r.name: r for r in IM.image_info(FS.scan_images(spark, d, "label")).collect()}
    assert (info["a.png"].format, info["a.png"].width, info["a.png"].height, info["a.png"].mode) == ("PNG", 40, 30, "RGB")
    assert info["b.PNG"].mode == "RGBA"
    assert info["c.jpg"].error is not None


def test_pixel_hash(spark, tmp_dir):
    d = _folder(tmp_dir)
    hashes = {r.name: r.bits for r in IM.hash_images(spark, d).collect()}
    assert hashes["f.Png"] == ("00001111" * 8)
    assert hashes["a.png"] == "0" * 64  # flat image: nothing above the mean


def test_lines_and_url_list(spark, tmp_dir):
    p = os.path.join(tmp_dir, "urls.txt")
    with open(p, "w") as f:
        f.write("http://a\n\n  http://b  \nhttp://c\n")
    lines = FS.read_lines(spark, p).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "http://a"), (2, ""), (3, "  http://b  "), (4, "http://c")]
    urls = FS.read_url_list(spark, p).orderBy("ord").collect()
    assert [(r.ord, r.url) for r in urls] == [(0, "http://a"), (1, "http://b"), (2, "http://c")]
    out = os.path.join(tmp_dir, "urls_out")
    W.write_url_list(FS.read_url_list(spark, p), out)
    back = FS.read_url_list(spark, out).orderBy("ord").collect()
    assert [r.url for r in back] == ["http://a", "http://b", "http://c"]


def test_jsonl_round_trip_keeps_nulls(spark, tmp_dir):
    lines = ['{"document_category":"id","error":null}', '{"document_category":null,"x":[1]}']
    parsed = L.parse_log(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string"))
    out = os.path.join(tmp_dir, "labels")
    W.write_jsonl(parsed, out, rec_col="rec")
    back = L.parse_log(FS.read_lines(spark, out))
    got = sorted(r.status for r in back.collect())
    assert got == ["failed", "ok"]
    texts = sorted(json.dumps(json.loads(r.line), sort_keys=True) for r in back.collect())
    assert texts == sorted(json.dumps(json.loads(x), sort_keys=True) for x in lines)


def test_store_append_is_idempotent(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    assert FS.read_store(spark, path).count() == 0
    rows = spark.createDataFrame([(1, "0" * 64, "a", 0)], "hash long, bits string, file string, ord long")
    W.append_store(rows, path, 0)
    W.append_store(rows, path, 0)  # replay
    W.append_store(rows.withColumn("file", F.lit("b")), path, 1)
    assert sorted((r.batch_id, r.file) for r in FS.read_store(spark, path).collect()) == [(0, "a"), (1, "b")]


def test_store_json_import(spark, tmp_dir):
    p = os.path.join(tmp_dir, "hashes.json")
    with open(p, "w") as f:
        json.dump({"ffffffffffffffff": "a.jpg", "0000000000000001": "b.jpg"}, f, indent=2)
    rows = {r.file: (r.hash, r.bits) for r in FS.import_store_json(spark, p).collect()}
    assert rows["a.jpg"] == (-1, "1" * 64)
    assert rows["b.jpg"] == (1, "0" * 63 + "1")


def test_summary_report(spark, tmp_dir):
    lines = ['{"document_category":"id","ocr_difficulty":"easy","language_primary":"en"}',
             '{"document_category":"id","ocr_difficulty":"hard"}', '{"error":"x"}']
    parsed = L.parse_log(spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string"))
    out = os.path.join(tmp_dir, "summary")
    W.write_summary(parsed, out)
    text = [r.value for r in spark.read.text(out).collect()]
    assert "- Success Rate: 66.7%" in text
    assert "- id: 2 (100.0%)" in text
    assert "- Unknown: 1 (50.0%)" in text
    assert text.index("## Document Categories") < text.index("- id: 2 (100.0%)") < text.index("## OCR Difficulty Distribution")


def test_step_status(spark):
    steps = spark.createDataFrame([("search", "success"), ("label", "failed")], "step string, status string")
    r = W.step_status(steps).first()
    assert r.all_ok is False and r.steps["search"] == "success"


def test_strict_loader_fails_on_bad_line(spark, tmp_dir):
    import pytest
    p = os.path.join(tmp_dir, "d.jsonl")
    with open(p, "w") as f:
        f.write('{"document_category":"a"}\n{"document_category": "broken\n')
    schema = "document_category string"
    with pytest.raises(Exception):
        FS.read_strict_jsonl(spark, p, schema).collect()
    with open(p, "w") as f:
        f.write('{"document_category":"a"}\n')
    assert FS.read_strict_jsonl(spark, p, schema).first().document_category == "a"
