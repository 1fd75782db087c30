"""Runs equal a slow search of every lag; splitting loses none."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docsift.llm import periodic
from docsift.llm.queries import QUERIES


def slow_runs(words):
    """Every maximal stretch of each lag, kept if no smaller lag fits it whole."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(24, 3 * q):
                run = words[at:at + length]
                if all(any(run[i] != run[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    found = slow_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return words, found, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    random.seed(11)
    out = ["", " \n\t", "one", "a " * 23, "a " * 24, "a b " * 12, "x\x0by\x0cz\rw " * 20, "a b " * 30, "\x1c \x85 " * 40]
    for _ in range(60):
        words = []
        while len(words) < random.randrange(5, 400):
            if random.random() < 0.5:
                words += random.choices("abcdefgh", k=random.randrange(1, 12))
            else:
                p = random.choices("abcdefghij", k=random.randrange(1, 30))
                words += (p * 12)[:random.randrange(len(p), 6 * len(p) + 20)]
        out.append(random.choice([" ", "\n", "\t "]).join(words))
    out.append(" ".join(random.choices("ab", k=700)))
    out.append(" ".join((["p", "q", "r"] * 40 + ["s"]) * 5))  # runs inside a longer run
    return out


TEXTS = texts()


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_runs_equal_slow_search(k):
    words, found, best, left = slow_row(TEXTS[k])
    ids, forms = periodic.numbered_words(TEXTS[k].encode())
    assert [forms[i].decode() for i in ids] == words
    assert periodic.runs(ids) == found
    n, got, top, text = periodic.collapse(TEXTS[k])
    assert n == len(words) and text == left
    assert (top and (top["start"], top["length"], top["period"])) == best


def test_small_pieces_and_probe_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 7)
    monkeypatch.setattr(periodic, "PROBES", 5)
    for t in TEXTS:
        ids, _ = periodic.numbered_words(t.encode())
        assert periodic.runs(ids) == slow_row(t)[1]


def test_splitting_leaves_no_rare_word():
    ids = np.array([random.randrange(40) for _ in range(3000)], np.int32)
    for start, end in periodic.segments(ids):
        assert end - start >= 24 and min(np.unique(ids[start:end], return_counts=True)[1]) >= 3


def test_prose_leaves_no_segment():
    assert periodic.segments(np.arange(100_000, dtype=np.int32) // 2) == []


def test_long_periodic_text_is_fast():
    ids = np.tile(np.arange(1000, dtype=np.int32), 500)
    assert periodic.runs(ids) == [(0, 500_000, 1000)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_against_slow_search(spark, tmp_dir):
    random.seed(3)
    rows = [(i, " ".join(random.choices(["ab", "cd", "ef"] if i % 5 else [str(j) for j in range(50)], k=random.randrange(0, 120)))) for i in range(150)]
    rows += [(None, "z " * 30), (7, "twice " * 40), (7, "twice " * 40), (500, None), (501, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, runs int, best string").repartition(3)
    df.write.parquet(f"{tmp_dir}/t/documents.parquet")
    want, n_planted = [], 0
    for d, t in rows:
        words = slow_row(t)[0]
        changed = planted(d, words)
        n_planted += changed != words
        words, found, best, left = slow_row(" ".join(changed))
        s, n, q = best or (None, None, None)
        want.append((d, len(found), s, n, q, best and 1000 * n // q, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                     hashlib.sha256(left.encode()).hexdigest()))
    got = QUERIES["op11_periodic_runs"](spark, f"{tmp_dir}/t")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and n_planted > 5


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id string, text string, collapsed int")).count() == 0
