"""Fingerprints equal a slow winnowing; the match guarantee; documents meet their next ones."""

import hashlib
import random

import numpy as np
import pytest

from docsift.llm import winnowing
from docsift.llm.queries import QUERIES

random.seed(12)
K, W = winnowing.GRAM, winnowing.WINDOW


def prose(n):
    return " ".join("".join(random.choices("abcdefgh é漢", k=random.randrange(1, 9))) for _ in range(n))


TEXTS = ["", "a", "ab" * 11, "x" * 24, "x" * 25, "x" * 500, "ab" * 300, "🙂" * 70, "\x00\n\t" * 30, prose(4), prose(12), prose(60), prose(900)]


def slow_hash(gram):
    h = sum((ord(c) + 1) * pow(winnowing._BASE, i, 1 << 64) for i, c in enumerate(gram)) & winnowing._MASK
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & winnowing._MASK
    return h ^ h >> 32


def slow_winnow(text, k, w):
    if not text:
        return []
    k = min(k, len(text))
    h = [slow_hash(text[i:i + k]) for i in range(len(text) - k + 1)]
    w, marks = min(w, len(h)), set()
    for i in range(len(h) - w + 1):
        least = min(h[i:i + w])
        marks.add(max(j for j in range(i, i + w) if h[j] == least))
    return [(h[j], j) for j in sorted(marks)]


def pairs(text, k=K, w=W):
    h, at = winnowing.winnow(text, k, w)
    return [(x, i) for x, i in zip(h.view(np.uint64).tolist(), at.tolist())]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_equals_slow_winnowing(i):
    assert pairs(TEXTS[i]) == slow_winnow(TEXTS[i], K, W)
    assert pairs(TEXTS[i], 3, 4) == slow_winnow(TEXTS[i], 3, 4)


def test_blocks_do_not_change_it(monkeypatch):
    want = [pairs(t) for t in TEXTS]
    for size in (1, 7, 100):
        monkeypatch.setattr(winnowing, "BLOCK", size)
        assert [pairs(t) for t in TEXTS] == want


def test_match_guarantee():
    for _ in range(50):
        shared = prose(40)[:K + W - 1]
        assert len(shared) == K + W - 1
        a, b = prose(random.randrange(30)) + shared + prose(9), prose(random.randrange(30)) + shared + prose(5)
        at = a.index(shared), b.index(shared)
        inside = [{(h, i - at[n]) for h, i in pairs(t) if at[n] <= i <= at[n] + W - 1} for n, t in enumerate((a, b))]
        assert inside[0] & inside[1]


def test_density():
    text = prose(40_000)
    assert abs(len(pairs(text)) / len(text) * (W + 1) / 2 - 1) < 0.05


def expected(rows):
    """Rows of the query by a plain walk over the distinct (id, text)."""
    from pyspark.sql import SparkSession, functions as F

    spark = SparkSession.getActiveSession()
    rows = [(d, t or "") for d, t in rows]
    distinct = list(dict.fromkeys(rows))
    hashed = spark.createDataFrame([(t,) for _, t in distinct], "t string").select("t", F.xxhash64("t").alias("h")).distinct().collect()
    h = {r.t: r.h for r in hashed}
    order = sorted(distinct, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]]), reverse=True)
    after = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    out = []
    for r in rows:
        text, following = r[1], after[r][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]

        def show(t):
            return ",".join(f"{x:016x}:{i}" for x, i in slow_winnow(t, K, W))

        def near(t):
            a, b = ({x for x, _ in slow_winnow(u, K, W)} for u in (text, t))
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), show(text), show(edited), near(edited), near(following)))
    return out


def ask(spark, folder, rows, kind="bigint", parts=3):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], f"doc_id {kind}, text string, h int, label string")
    df.repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, QUERIES["op12_winnowing"](spark, folder).collect()), key=repr)


ROWS = [(i * 7 % 101, TEXTS[i % len(TEXTS)] + prose(i % 40)) for i in range(101)]


def test_query_columns(spark, tmp_dir):
    rows = [*ROWS, (None, "null id " * 20), (None, None), (5, "same id " * 9), (5, "same id, other text"), (8, "twice " * 30), (8, "twice " * 30)]
    assert ask(spark, f"{tmp_dir}/a", rows) == sorted(expected(rows), key=repr)
    assert ask(spark, f"{tmp_dir}/b", rows, parts=7) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("rows", [[(3, "alone " * 30)], [(1, "a " * 40), (2, "b " * 40)], [(1, None), (2, ""), (3, "x")], [(4, "copy " * 20)] * 9], ids=len)
def test_small_tables(spark, tmp_dir, rows):
    assert ask(spark, f"{tmp_dir}/t", rows) == sorted(expected(rows), key=repr)


def test_hot_rows_take_several_labels(spark, tmp_dir):
    rows = [*ROWS[:40], *[(3 * 7, "hot " * 40)] * 300, *[(None, "hot too " * 20)] * 100]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("h", F.xxhash64("text"))
    plan = winnowing.ranges(df, winnowing.RANGE_CHARS)
    assert len(plan.hot) == 2 and plan.n_labels > 8
    assert ask(spark, f"{tmp_dir}/t", rows, parts=5) == sorted(expected(rows), key=repr)


def test_string_ids_and_many_ranges(spark, tmp_dir, monkeypatch):
    rows = [(f'{d:03}"', t) for d, t in ROWS[:40]]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = winnowing.against_next(df, range_chars=1).select("doc_id", "edited_sha256").collect()
    by_id = dict(rows)
    names = sorted(by_id, reverse=True)
    for r in got:
        text, following = by_id[r.doc_id], by_id[names[(names.index(r.doc_id) + 1) % len(names)]]
        assert r.edited_sha256 == hashlib.sha256(winnowing._edited(text, following).encode()).hexdigest()
    assert len(got) == len(rows)


def test_empty_table_and_plain_fingerprints(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, fingerprint int")
    assert winnowing.against_next(empty).count() == 0 and winnowing.fingerprints(empty).count() == 0
    df = spark.createDataFrame([(1, TEXTS[-1], 0), (None, None, 0), (2, TEXTS[-1], 0)], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: r for r in winnowing.fingerprints(df).collect()}
    assert [(m["hash"] & winnowing._MASK, m["pos"]) for m in got[1].fingerprint] == slow_winnow(TEXTS[-1], K, W)
    assert got[2].fingerprint == got[1].fingerprint and got[None].fingerprint == [] and got[None].n_chars == 0
