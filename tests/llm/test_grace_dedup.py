"""Exact dedup: groups by brute force, recursion, collisions, odd rows."""

import hashlib

import pytest

from docsift.llm import grace_dedup as G

WS = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(WS), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t in rows:
        n = (t or "").translate(WS)
        keep = min(groups[n], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = ([(i, "same  text here" if i % 3 else "same text here") for i in range(200)] + [(1000, None), (1001, ""), (1002, " \n\t"),
        (1003, "Ünïcode   kept"), (1004, "Ünïcode kept"), (1005, "x" * 300_000), (1006, "x " * 300_000), (None, "lonely"),
        (2000, "lonely"), (None, "null id only"), (3000, "twice"), (3000, "twice")] + [(4000 + i, f"text number {i % 70}") for i in range(140)])


@pytest.mark.parametrize("bucket", [G.BUCKET_BYTES, 2000])
def test_against_brute_force(spark, bucket):
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in ROWS], "doc_id bigint, text string, kept int, digest string").repartition(7)
    out = G.exact_groups(df, bucket_bytes=bucket)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(ROWS)


def test_empty_table(spark):
    assert G.exact_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_table_compares_contents_not_hashes():
    t = G.ContentTable(4)
    for i in range(50):
        t.add(12345, b"%d" % (i % 5), 1, (-3, False, i, 0), 1)
    assert [(e[1], e[3], e[4][2]) for e in t.entries] == [(b"%d" % i, 10, i) for i in range(5)]


def test_buckets_are_split_until_they_fit(spark):
    rows = [(i << 50 | 5, b"c" * 100) for i in range(64)] + [((1 << 62) + i, b"d" * 100) for i in range(64)]
    df = spark.createDataFrame(rows, "h bigint, content binary")
    sized = df.withColumn("bucket", G.bucket_column(df, 3000)).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sized) <= 10 or all(int(r.bucket.split(":")[0]) >= 60 for r in sized if r["count"] > 10)
    assert len({int(r.bucket.split(":")[0]) for r in sized}) > 1


def test_one_row_of_each_group_is_left(spark):
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in ROWS], "doc_id bigint, text string, key int, digest string").repartition(5)
    out = G.drop_copies(df)
    assert out.columns == df.columns
    left = sorted(((r.doc_id, (r.text or "").translate(WS)) for r in out.collect()), key=repr)
    assert left == sorted({(k, (t or "").translate(WS)) for (d, t), k in zip(ROWS, (dict((repr((b[0], b[4])), b[1]) for b in brute(ROWS))[repr((d, hashlib.sha256((t or "").translate(WS).encode()).hexdigest()))] for d, t in ROWS))}, key=repr)
