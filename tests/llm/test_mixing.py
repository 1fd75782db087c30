"""Mixing: targets by repeated resharing, quotas, caps, reruns, odd rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docsift.llm import mixing as M


def reshare(sizes):
    """Targets by the rule as it is told: share, cap, reshare until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        rate = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if rate * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: rate * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def table(spark):
    rows = [(i, "w " * (i % 300), f"s{i % 7}") for i in range(900)] + [(i, f"big {i} " * 90, "hot") for i in range(1000, 1600)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, " \n", None), (2003, "a b c", None), (None, "x y z", "Ω"), (None, "x y z", "Ω"),
             (3000, "twice over " * 50, "s2"), (3000, "twice over " * 50, "s2"), (4000, "long " * 40_000, "s3"), (5000, None, "empty")]
    return spark.createDataFrame([(d, t, s, 5, 1) for d, t, s in rows], "doc_id bigint, text string, source string, size int, taken int"), rows


def test_targets_and_taken(spark):
    df, rows = table(spark)
    mixed = M.mix(df.repartition(5))
    out = mixed.documents.collect()
    assert Counter((r.doc_id, r.size, r.source) for r in out) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = reshare(dict(sizes))
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= M.BLOCK_WORDS
    again = M.mix(df.repartition(3).orderBy(F.rand(1))).documents.collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_slots_use_every_block_before_any_twice(spark):
    df, _ = table(spark)
    slots = M.mix(df).slots.collect()
    assert sorted(r.slot for r in slots) == list(range(len(slots)))
    uses = defaultdict(Counter)
    for r in slots:
        uses[r.source][r.block] += 1
    for c in uses.values():
        assert max(c.values()) <= 2
        assert max(c.values()) < 2 or set(c) == set(range(max(c) + 1))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 64, 1000, 4099])
def test_permutation(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
    got = [r.p for r in df.select(M.permuted(F.col("id"), F.col("n"), F.lit(1), F.lit(2)).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


def test_empty_tables(spark):
    schema = "doc_id bigint, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).documents.count() == 0
    out = M.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).documents.collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


def test_mixed_texts_hold_what_is_taken(spark):
    df, _ = table(spark)
    mixed = M.mix(df)
    texts = M.mixed_texts(df, mixed)
    assert texts.columns == df.columns
    got, want = Counter(), Counter()
    for r in texts.collect():
        assert r.text and r.text == r.text.strip()
        got[r.doc_id] += len(r.text.split())
    for r in mixed.documents.collect():
        want[r.doc_id] += r.taken
    assert got == +want
