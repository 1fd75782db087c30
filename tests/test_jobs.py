"""End-to-end jobs over files made in the test."""

import os
import random
import struct
import zlib

from docsift.plans import jobs


def noise_png(w, h, seed):
    rnd = random.Random(seed)

    def chunk(kind, data):
        c = struct.pack(">I", len(data)) + kind + data
        return c + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)
    def row():
        left = bytes(rnd.randrange(0, 100) for _ in range(3 * (w // 2)))
        right = bytes(rnd.randrange(150, 256) for _ in range(3 * (w - w // 2)))
        return b"\x00" + left + right
    raw = b"".join(row() for _ in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_accept_images(spark, tmp_dir):
    d = os.path.join(tmp_dir, "images")
    os.makedirs(d)
    img = noise_png(320, 320, 1)
    for name, data in {"a.png": img, "b.png": img, "c.png": noise_png(100, 100, 2), "d.jpg": b"\xff\xd8" + b"0" * 6000}.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    got = {os.path.basename(r.path): r.status for r in jobs.accept_images(spark, d).collect()}
    assert got == {"a.png": "accepted", "b.png": "duplicate", "c.png": "invalid", "d.jpg": "invalid"}


def test_validate_job(spark, tmp_dir):
    p = os.path.join(tmp_dir, "labels.jsonl")
    with open(p, "w") as f:
        f.write('{"document_category":"id","document_subcategory":"x","language_primary":"en",'
                '"text_clarity":"clear","image_quality":"high","ocr_difficulty":"easy"}\n\nnot json\n{"error":"x"}\n')
    out = jobs.validate(spark, p)
    s = out["summary"].first()
    assert (s.total_records, s.valid_classifications) == (2, 1)
    assert sorted((r.line_no, r.reason) for r in out["invalid_lines"].collect()) == [(2, "blank"), (3, "invalid_json")]
