"""Line dedup against a brute-force walk over all windows."""

import random

from docsift.llm import line_dedup as L


def brute(rows):
    """rows with distinct ids, in order of id -> (id, lines, removed, text)."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(full) - 2):
            w = tuple(lines[i] for i in full[k:k + 3])
            if w in seen:
                gone |= set(range(full[k], full[k + 2] + 1))
            seen.add(w)
        out.append((d, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


random.seed(8)
PASSAGE = "shared one\nshared two\nshared three\nshared four"


def _rows():
    out = [(i, "\n".join(random.choice("abcde") for _ in range(random.randint(0, 12)))) for i in range(120)]
    out += [(200 + i, f"own {i}\n{PASSAGE}\n\nown tail {i}") for i in range(40)]
    out += [(300, None), (301, ""), (302, "\n\n\n"), (303, "one\ntwo"), (304, "x\n\ny\n \nz"), (305, "x\n\ny\n \nz"), (306, "x\ny\nz\n"),
            (307, "same\n" * 50), (308, "\n".join(f"line {i}" for i in range(20_000))), (309, "pre\n" + "\n".join(f"line {i}" for i in range(0, 20_000))),
            (None, PASSAGE), (310, "ünï\r\ncode\r\n漢字\r\n"), (311, "ünï\r\ncode\r\n漢字\r\n")]
    return out


ROWS = _rows()


def test_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in ROWS], "doc_id bigint, text string, row int, h1 string").repartition(6)
    assert sorted((tuple(r) for r in L.drop_repeated(df).collect()), key=repr) == brute(ROWS)


def test_repeated_rows_keep_one_and_empty_table(spark):
    df = spark.createDataFrame([(1, PASSAGE)] * 3, "doc_id bigint, text string")
    assert sorted(r.n_removed for r in L.drop_repeated(df).collect()) == [0, 4, 4]
    assert L.drop_repeated(df.limit(0)).count() == 0
