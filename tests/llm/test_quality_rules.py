"""Quality rules: counts by brute force, thresholds per group, odd rows."""

import random
import re

from docsift.llm import quality_rules as Q

WORD = re.compile(r"[^ \t-\r]+")


def counted(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


random.seed(3)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "漢字", "iota"] + [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


ROWS = [(i, prose(60 + i % 200), "en" if i % 3 else None, f"s{i % 2}") for i in range(400)]
ROWS += [(1000 + i, "%% ".join(prose(90).split()), "en", "s0") for i in range(5)]
ROWS += [(2000, None, "en", None), (2001, "", None, None), (2002, " \n\t\x0b", "en", "s0"), (2003, "a b", "de", "x"), (2004, "one two three " * 40, "en", "s1"),
         (2005, "line one\nline two\n\nline one\n  \nline one\n" + prose(80), "en", "s1"), (2006, "| a | b |\n" * 20 + prose(60), "de", "x"),
         (2007, prose(30_000), "en", "s0"), (None, prose(70), "fr", "rare"), (2008, prose(77), "en", "s0"), (2008, "x" * 100_000 + " " + prose(80), "en", "s1"),
         (2009, "a a a a a a a " + prose(60), "en", "s1"), (2010, "a b\tc\x0ba b c " + prose(60), "en", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, 1, 2.5) for d, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, kept int, n_words double")


def test_signals_against_brute_force(spark):
    got = sorted((tuple(r)[:7] for r in Q.judge(frame(spark, ROWS).repartition(4)).collect()), key=repr)
    assert got == sorted(((d, *counted(t)) for d, t, _, _ in ROWS), key=repr)


def test_verdicts(spark):
    out = {}
    for r in Q.judge(frame(spark, ROWS)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert all(r.kept for d in range(400) for r in out[d])
    assert not any(out[1000 + i][0].kept for i in range(5))
    assert not any(out[d][0].kept for d in (2000, 2001, 2002, 2003, 2004))
    assert all(not r.kept for rs in out.values() for r in rs if r.base_failed)
    assert out[None][0].kept and out[2007][0].kept


def test_a_source_keeps_what_is_usual_in_it(spark):
    code = [(i, " ".join(w + random.choice(("%", "&", "|", "")) for w in prose(90).split()), "en", "code") for i in range(300)]
    text = [(1000 + i, prose(90), "en", "prose") for i in range(300)]
    odd = [(5000, code[0][1], "en", "prose")]
    out = {r.doc_id: r.kept for r in Q.judge(frame(spark, code + text + odd)).collect()}
    assert all(out[i] for i in range(300)) and not out[5000]


def test_sketch_quantiles_are_accurate_and_merge(spark):
    rows = [(i, prose(50 + i), "en", f"s{i % 5}") for i in range(500)]
    rated = Q.with_base(Q.signals(frame(spark, rows)))
    whole = Q.tails(Q.sketches(rated), "lang").first()
    lengths = sorted(sum(map(len, t.split())) / len(t.split()) for _, t, _, _ in rows)
    for q, got in zip(Q.TAILS, whole["word_length"]):
        exact = lengths[int(q * len(lengths)) - 1]
        assert abs(got - exact) <= 1.1 * Q.ACCURACY * exact


def test_empty_table(spark):
    assert Q.judge(frame(spark, ROWS).limit(0)).count() == 0


def test_fences_follow_the_source_where_constants_would_not(spark):
    """Lists repeat a tenth of their lines, prose none: the same share of repeated
    lines passes in one source and fails in the other."""
    def lines(n, repeated):
        own = [f"{prose(6)} {i}" for i in range(n - repeated)]
        return "\n".join(own + random.choices(own, k=repeated))

    lists = [(i, lines(30, random.randint(2, 5)), "en", "lists") for i in range(300)]
    pages = [(1000 + i, lines(30, 0), "en", "pages") for i in range(300)]
    odd = [(5000, lists[0][1], "en", "pages")]
    out = {r.doc_id: r.kept for r in Q.judge(frame(spark, lists + pages + odd)).collect()}
    assert all(out[i] for i in range(300)) and all(out[1000 + i] for i in range(300)) and not out[5000]
    limits = {r.source: r for r in Q.thresholds(Q.sketches(Q.with_base(Q.signals(frame(spark, lists + pages))))).collect()}
    assert limits["lists"].dup_line_ratio_max > 5 * limits["pages"].dup_line_ratio_max
