"""SimHash: fingerprints by the definition, links and components by brute force."""

import numpy as np
import pytest
import xxhash

from docsift.llm import simhash_trie as S
from docsift.llm.components import connected_components


def fingerprint(text):
    ws = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    w = [x for x in ws.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """doc_id -> (fingerprint, smallest reachable id), ids not null and distinct."""
    fp = {d: fingerprint(t) for d, t in rows}
    comp = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if bin(fp[a] ^ fp[b]).count("1") <= 2 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return {d: (f"{fp[d]:016x}", comp[d]) for d in fp}


TEXTS = ["", None, " \t\n", "One", "one two", "one TWO three", "one two three four", "Äpfel und Birnen",
         "a b c " * 50, "a b c " * 51, "x" * 20000, "w " * 3000 + "end", "no split here now"]


def test_simhash_by_definition():
    for t in TEXTS:
        assert S.simhash(t) == fingerprint(t), t


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_trie_pairs_against_all_pairs(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 600), dtype=np.uint64)
    near = rng.choice(base, 600) ^ flips[0] ^ flips[1] * rng.integers(0, 2, 600).astype(np.uint64)
    fp = np.unique(np.concatenate([base, near, np.array([0, 2**64 - 1], np.uint64)]))
    got = set()
    for i, j in S.trie_pairs(fp, fp, budget):
        got |= set(zip(i.tolist(), j.tolist()))
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= budget))))


def test_near_pairs_across_cells(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fp = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fp.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fp]
    got = {(r.a, r.b) for r in S.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(5)).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want and want


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(500 + i, 500) for i in range(50)] + [(7, 7), (1, 0), (-5, 900)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {500 + i: 500 for i in range(50)} | {-5: -5, 900: -5}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    long = " ".join(f"word{i % 97}x{i % 31}" for i in range(900))
    rows += [(100 + i, long + f" tail{i}") for i in range(8)] + [(300, long), (301, long.upper())]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


def test_one_row_of_each_component_is_left(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a b c d"), (None, "a b c d"), (None, "only null id"), (50, "one two THREE four")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, fp string, n int")
    out = S.drop_near_duplicates(df)
    known = brute([r for r in rows if r[0] is not None])
    want = {c for _, c in known.values()}
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2
