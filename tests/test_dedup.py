"""Banded Hamming join against brute force; greedy leader semantics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import dedup as DD
from docsift.operators import greedy
from docsift.operators.hamming import near_pairs
from docsift.session import write_table


def _bits(h):
    return format(h & (2**64 - 1), "064b")


def _greedy(items, t):
    kept = []
    for o, h in items:
        if all(bin(h ^ k).count("1") > t for _, k in kept):
            kept.append((o, h))
    return [o for o, _ in kept]


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(150)]
    hashes = list(base)
    for h in base[:60]:  # near copies at distance 1..6
        x = h
        for b in rnd.sample(range(64), rnd.randint(1, 6)):
            x ^= 1 << b
        hashes.append(x)
    hashes = list(dict.fromkeys(hashes))
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "ord long, hash long")
    for t in (0, 3, 5, 9):
        got = {(r.id_a, r.id_b, r.distance) for r in near_pairs(df, threshold=t).collect()}
        want = {(i, j, bin(hashes[i] ^ hashes[j]).count("1")) for i in range(len(hashes))
                for j in range(i + 1, len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= t}
        assert got == want


def test_chain_keeps_both_ends(spark):
    a = 0
    b = 0b111          # d(a,b)=3
    c = 0b111111       # d(b,c)=3, d(a,c)=6
    rows = [(0, _bits(a)), (1, _bits(b)), (2, _bits(c))]
    df = spark.createDataFrame(rows, "ord long, bits string")
    assert sorted(r.ord for r in DD.leaders(df, 5).collect()) == [0, 2]
    groups = {(r.leader, r.member) for r in DD.groups(DD.dedup_plan(df, 5)).collect()}
    assert groups == {(0, 0), (0, 1)}


def test_leaders_match_sequential_walk(spark):
    rnd = random.Random(7)
    centers = [rnd.getrandbits(64) for _ in range(40)]
    items = []
    for i in range(400):
        h = rnd.choice(centers)
        for b in rnd.sample(range(64), rnd.randint(0, 4)):
            h ^= 1 << b
        items.append((i, h))
    df = spark.createDataFrame([(o, _bits(h)) for o, h in items], "ord long, bits string")
    # the walk runs over distinct hashes in first-seen order
    firsts = {}
    for o, h in items:
        firsts.setdefault(h, o)
    want = _greedy(sorted((o, h) for h, o in firsts.items()), 5)
    got = sorted(r.ord for r in DD.leaders(df, 5).collect())
    assert got == sorted(want)


def test_exact_copies_are_removed(spark):
    rows = [(0, _bits(5)), (1, _bits(5)), (2, _bits(5 ^ 1))]
    plan = DD.dedup_plan(spark.createDataFrame(rows, "ord long, bits string"), 5)
    removed = {(r.ord, r.reason) for r in DD.removed(plan).collect()}
    # the hash's last file is the one kept (later same-hash file replaces earlier)
    assert removed == {(0, "exact"), (2, "near")}


def test_incremental_against_store(spark):
    store = spark.createDataFrame([(100, _bits(0))], "ord long, bits string")
    far = 2**40 - 1  # 40 bits away from the stored hash
    batch = spark.createDataFrame([(1, _bits(1)), (2, _bits(far)), (3, _bits(far ^ 1)), (4, _bits(far))],
                                  "ord long, bits string")
    got = {r.ord: r.status for r in DD.incremental(batch, store, 5).collect()}
    assert got == {1: "duplicate", 2: "new", 3: "duplicate", 4: "duplicate"}


def test_a_large_cluster_makes_no_quadratic_table(spark):
    """5,000 near copies of one hash: every one within 5 bits of the first."""
    rnd = random.Random(3)
    center = rnd.getrandbits(64)
    hashes = [center]
    seen = {center}
    while len(hashes) < 5000:
        h = center
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            h ^= 1 << b
        if h not in seen:
            seen.add(h)
            hashes.append(h)
    df = spark.createDataFrame([(i, _bits(h)) for i, h in enumerate(hashes)], "ord long, bits string")
    nodes = write_table(DD.collapse_exact(df), "test-nodes")
    assert [r.n for r in nodes.agg(F.count(F.lit(1)).alias("n")).collect()] == [5000]
    ends = DD.wave_ends(nodes)
    assert ends[0] == DD.FIRST_WAVE - 1
    owners = {r.node: r.leader for r in DD.assign(nodes, 5).collect()}
    assert set(owners.values()) == {0} and len(owners) == 5000
    # only the first wave is compared with itself
    first = nodes.filter(F.col("node") <= ends[0])
    assert near_pairs(first, None, 5, "node").count() <= DD.FIRST_WAVE ** 2 / 2


def test_long_chain_matches_the_walk(spark):
    """Each hash is near its neighbours alone, so every other one leads."""
    hashes, h = [], 0
    for i in range(600):
        h ^= sum(1 << ((7 * i + k) % 64) for k in range(3))
        hashes.append(h)
    items = list(dict.fromkeys(hashes))
    df = spark.createDataFrame([(i, _bits(x)) for i, x in enumerate(items)], "ord long, bits string")
    assert sorted(r.ord for r in DD.leaders(df, 5).collect()) == _greedy(list(enumerate(items)), 5)


def test_greedy_rounds_and_walk_agree(spark, monkeypatch):
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(120), 2))) for _ in range(300)} | {(i, i + 1) for i in range(200, 260)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    want = {r.id: r.leader for r in greedy.greedy(df).collect()}
    monkeypatch.setattr(greedy, "WALK_EDGES", 0)
    assert {r.id: r.leader for r in greedy.greedy(df).collect()} == want


def _random_rows(spark, n, seed, near_to=()):
    rnd = random.Random(seed)
    hashes = [rnd.getrandbits(64) for _ in range(n)] + [h ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for h in near_to]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    return hashes, spark.createDataFrame(list(enumerate(signed)), "node bigint, hash bigint")


def test_index_finds_near_hashes_and_opens_few_shards(spark, tmp_dir):
    from docsift.operators.hash_index import HashIndex

    index = HashIndex(spark, f"{tmp_dir}/index", 1, agree=2, shard_rows=60)
    asked = spark.createDataFrame([(1, 5)], "node bigint, hash bigint")
    assert index.near(asked).count() == 0 and index.opened_rows(asked) == 0
    stored = []
    for batch in range(2):
        hashes, rows = _random_rows(spark, 300, batch)
        stored += hashes
        index.append(rows, batch)
    index.append(rows, 1)  # a batch that is written again replaces itself
    total = index.rows().count()
    assert total == 600 * 3
    near = [h ^ 1 for h in (stored[0], stored[299], stored[300], stored[599])]
    asked = spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate([*near, 12345])], "node bigint, hash bigint")
    for _ in range(2):  # before compaction and after
        assert sorted(r.node for r in index.near(asked).collect()) == [0, 1, 2, 3]
        assert sorted(r.node for r in index.near(asked, but_batch=1).collect()) == [0, 1]
        index.compact()
        assert index.rows().count() == total
    number, shards = index.generation()
    assert shards == 30 and index.opened_rows(asked.limit(1)) <= 3 * 2 * 60 + 300  # three shards, about 60 rows each
    os.makedirs(f"{tmp_dir}/index/gen-{number + 1}-7/base")  # a compaction that died leaves the generation before in use
    assert index.generation() == (number, shards)


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_blocks_by_size_give_the_same_pairs(spark, agree):
    hashes, rows = _random_rows(spark, 300, 7)
    _, rows = _random_rows(spark, 300, 7, near_to=hashes[:60])
    want = sorted(tuple(r) for r in DD.node_pairs(rows, 5).collect())
    got = near_pairs(rows, None, 5, "node", agree=agree)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 60


def test_many_hashes_are_joined_in_passes(spark, monkeypatch):
    from docsift.operators import hamming

    assert len(hamming.passes(24_000_000, 5, 3)) == 56 and len(hamming.passes(1000, 5, 1)) == 1
    hashes, rows = _random_rows(spark, 200, 7)
    _, rows = _random_rows(spark, 200, 7, near_to=hashes[:40])
    want = sorted(tuple(r) for r in near_pairs(rows, None, 5, "node").collect())
    monkeypatch.setattr(hamming, "PASS_KEYS", 500)
    got = near_pairs(rows, None, 5, "node", agree=2, n=240)
    assert len(hamming.passes(240, 5, 2)) == 11
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 40


def test_no_table_of_hashes_or_owners_is_sent_through_the_driver(spark):
    """Written tables are small on disk, and Spark takes keys for as small as the hashes."""
    rnd = random.Random(9)
    rows = spark.createDataFrame([(i, _bits(rnd.getrandbits(64))) for i in range(700)], "ord long, bits string")
    plan = DD.dedup_plan(rows, 5)
    nodes = write_table(DD.collapse_exact(rows), "test-nodes")
    for df in (DD.groups(plan), DD.removed(plan), DD.leaders(rows, 5), DD.node_pairs(nodes, 5), near_pairs(nodes, nodes, 5, "node")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
