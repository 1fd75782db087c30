"""Toxicity and quality: held-out accuracy, features, leakage, odd rows."""

import random
import zlib

import numpy as np
import pytest

from docsift.llm import features as X
from docsift.llm import nbsvm, toxicity

random.seed(11)
PLAIN = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(300)]
BAD = ["nasty", "vileword"]


def prose(n):
    return " ".join(random.choice(PLAIN) for _ in range(n))


def corpus(n=600):
    docs, labels = [], []
    for i in range(n):
        words = prose(30 + i % 80).split()
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            words.insert(i % len(words), random.choice(BAD))
        text = " ".join(words)
        if bad:
            text = text.upper() if i % 2 else " ".join(w + "###" for w in words)
        docs.append((i, text, i % 2, 0.5))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id bigint, text string, score int, held_out double"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


@pytest.mark.parametrize("op, column", [(toxicity, 2), (nbsvm, 1)])
def test_held_out_accuracy_and_odd_rows(spark, op, column):
    docs, labels = corpus()
    odd = [(None, "null id " + prose(20), 0, 0.0), (9000, None, 0, 0.0), (9001, "", 0, 0.0), (9002, "\n \t", 0, 0.0), (9003, "", 0, 0.0),
           (9004, prose(60_000), 0, 0.0), (3, docs[3][1], 0, 0.0), (9005, "!" * 50_000, 0, 0.0)]
    df, lab = frames(spark, docs + odd, labels + [(None, 1, 1), (9000, None, None), (77777, 1, 0)])
    rows = op.score(df.repartition(3), op.train(df, lab)).collect()
    assert len(rows) == len(docs) + len(odd)
    k, fold = op.FOLD
    truth = {r[0]: r[column] for r in labels}
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % k == fold) for r in rows if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    empty = {round(r.score, 9) for r in rows if r.doc_id in (9000, 9001, 9002, 9003)}
    assert len(empty) == 1
    assert len({round(r.score, 9) for r in rows if r.doc_id == 3}) == 1


@pytest.mark.parametrize("op, label", [(toxicity, "toxic"), (nbsvm, "quality")])
def test_held_out_labels_are_never_read(spark, op, label):
    docs, labels = corpus(200)
    k, fold = op.FOLD
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % k == fold else (i, q, t) for i, q, t in labels]
    a, b = (op.train(*frames(spark, docs, x)) for x in (labels, flipped))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


@pytest.mark.parametrize("op", [toxicity, nbsvm])
def test_empty_tables_and_one_class(spark, op):
    docs, labels = corpus(60)
    df, lab = frames(spark, docs, labels)
    assert op.score(df.limit(0), op.train(df.limit(0), lab.limit(0))).count() == 0
    same = spark.createDataFrame([(i, 1, 1) for i, _, _ in labels], "doc_id bigint, quality int, toxic int")
    assert {round(r.score, 6) for r in op.score(df, op.train(df, same)).collect()}.pop() > 0.9


def test_ftrl_weights_are_sparse():
    docs, labels = corpus()
    xs = [toxicity.extract(d[1]) for d in docs]
    at, w, _ = toxicity.fit(xs, np.array([t for _, _, t in labels]))
    assert 0 < len(at) < 0.01 * len(np.unique(np.concatenate(xs)))
    assert set(X.mixed(np.array([zlib.crc32(b.encode()) for b in BAD], np.uint64) + np.uint64(1 << 32), toxicity.BITS).tolist()) <= set(at[w > 0.5].tolist())


def test_dual_descent_separates_and_keeps_its_box():
    rows = [(np.array([0, 2]), np.array([1.0, 0.5])), (np.array([1, 2]), np.array([1.0, 0.5]))] * 10
    w, bias = nbsvm.dual_descent(rows, np.array([1.0, -1.0] * 10))
    assert w[0] > 0 > w[1] and abs(bias) < 0.2


def test_features_see_whole_texts():
    long = "calm " * 200_000
    assert set(toxicity.extract("nasty")) <= set(toxicity.extract(long + "nasty"))
    assert len(nbsvm.extract(None)) == 0 and len(toxicity.extract(" ")) == 0
    assert len(nbsvm.extract("a a a")) > len(nbsvm.extract("a a"))


def ids_of(spark, docs, labels, parts, most=12_000):
    """(order, y) of the sample, from tables dealt over ``parts`` partitions."""
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int").repartition(parts)
    sample = X.training_sample(df, lab, "toxic", toxicity.FOLD, most, toxicity.SEED, toxicity.extract)
    return sorted((r.order, r.y, bytes(r.x)) for r in sample.collect())


def test_repeated_rows_leave_every_id_in_the_sample(spark):
    """One id repeated 60,000 times, once as a document and once as a label row."""
    docs = [(i, f"text number {i}") for i in range(301)]
    labels = [(i, i % 2) for i in range(301)]
    train = [i for i in range(301) if zlib.crc32(str(i).encode()) % 4 != 2]
    hot = train[7]
    want = ids_of(spark, docs, labels, 3)
    assert len(want) == len(train)
    assert ids_of(spark, docs + [docs[hot]] * 60_000, labels, 3) == want == ids_of(spark, docs + [docs[hot]] * 60_000, labels, 7)
    assert ids_of(spark, docs, labels + [labels[hot]] * 60_000, 7) == want
    assert len(ids_of(spark, docs + [docs[hot]] * 300, labels, 5, most=50)) == 50


def test_clashing_labels_and_texts_of_one_id(spark):
    docs, labels = [(1, "a b"), (1, "c d"), (5, "e"), (6, "f")], [(1, 0), (1, 1), (5, 0), (5, 0), (5, 1), (6, None), (6, 0), (6, 7)]
    rows = [ids_of(spark, docs[::step], labels[::step], parts) for step, parts in ((1, 1), (-1, 4), (1, 6))]
    assert rows[0] == rows[1] == rows[2]
    held = [i for i in (1, 5, 6) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(y for _, y, _ in rows[0]) == sorted(y for i, y in ((1, 1), (5, 0), (6, 0)) if i not in held)


def test_ftrl_equals_a_plain_loop():
    """The same updates with dictionaries, one coordinate at a time."""
    docs, labels = corpus(150)
    xs = [toxicity.extract(d[1]) for d in docs]
    y = [t for _, _, t in labels]
    share = (sum(y) + 1) / (len(y) + 2)
    z, n, bias, bias_n = {}, {}, np.log(share / (1 - share)), 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    rng = np.random.default_rng(toxicity.SEED)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(y)):
            w = {i: weight(i) for i in xs[k].tolist()}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y[k]
            for i, v in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old ** 0.5) / toxicity.ALPHA * v
                n[i] = old + g * g
            bias_n += g * g
            bias -= toxicity.ALPHA * g / (toxicity.BETA + bias_n ** 0.5)
    want = {i: weight(i) for i in z if weight(i)}
    at, w, (got_bias,) = toxicity.fit(xs, np.array(y))
    assert sorted(want) == at.tolist() and np.allclose(w, [want[i] for i in at.tolist()]) and np.isclose(got_bias, bias)


def test_log_ratios_and_dual_descent_equal_plain_forms():
    docs, labels = corpus(120)
    xs = [nbsvm.extract(d[1]) for d in docs]
    y = np.array([q for _, q, _ in labels])
    r = nbsvm.log_ratios(xs, y)
    held = [{}, {}]
    for x, q in zip(xs, y.tolist()):
        for i in x.tolist():
            held[q][i] = held[q].get(i, 0) + 1
    totals = [sum(h.values()) + nbsvm.SMOOTH * nbsvm.SIZE for h in held]
    for i in range(nbsvm.SIZE):
        n = [h.get(i, 0) for h in held]
        if sum(n) < nbsvm.LEAST_ROWS:
            assert r[i] == 0
        else:
            assert np.isclose(r[i], np.log((n[1] + nbsvm.SMOOTH) / totals[1]) - np.log((n[0] + nbsvm.SMOOTH) / totals[0]))
    rows = [nbsvm.scaled(x, r) for x in xs]
    sign = 2.0 * y - 1
    w, bias = nbsvm.dual_descent(rows, sign)
    # the same descent with dictionaries
    plain, plain_bias, dual = {}, 0.0, [0.0] * len(rows)
    rng = np.random.default_rng(nbsvm.SEED)
    for _ in range(nbsvm.EPOCHS):
        change = 0.0
        for k in rng.permutation(len(rows)).tolist():
            x = dict(zip(rows[k][0].tolist(), rows[k][1].tolist()))
            slope = sign[k] * (sum(plain.get(i, 0.0) * v for i, v in x.items()) + plain_bias) - 1
            best = min(max(dual[k] - slope / (sum(v * v for v in x.values()) + 1), 0.0), nbsvm.C)
            step, dual[k] = best - dual[k], best
            for i, v in x.items():
                plain[i] = plain.get(i, 0.0) + step * sign[k] * v
            plain_bias += step * sign[k]
            change = max(change, abs(step))
        if change < 1e-3:
            break
    assert np.isclose(bias, plain_bias) and np.allclose(w[list(plain)], list(plain.values())) and set(np.flatnonzero(w).tolist()) <= set(plain)
