"""The pipeline: each stage against brute force on its own input, then run()."""

import hashlib
import importlib
import os
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as P
from docsift.llm import bpe, nbsvm, queries
from tests.llm.test_classifiers import corpus
from tests.llm.test_grace_dedup import WS
from tests.llm.test_simhash_trie import fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus(300)
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t, *_ in docs]
    by_id = {r[0]: r[1] for r in rows}
    good = [d for d, q, _ in labels if q][:30]
    rows += [(1000 + i, "  " + by_id[d].replace(" ", "\n"), "en", "s1", 0) for i, d in enumerate(good[:10])]  # exact copies
    rows += [(1100 + i, by_id[d] + " tail", None, None, 0) for i, d in enumerate(good[10:20])]  # near copies
    rows += [rows[2], (None, "null id " + by_id[2], "en", "s0", 0), (2000, None, None, None, None), (2001, "", "en", "s2", 0)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        inputs[name] = docs
        out = stage(spark, docs, folder)
        if name != "tokenize":
            assert out.columns == columns
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        inputs[f"{name}:out"] = docs

    def rows(name):
        return sorted((tuple(r) for r in inputs[name].collect()), key=repr)

    # quality: the rows that the classifier predicts 1 for
    model = nbsvm.train(inputs["quality"], spark.read.parquet(f"{folder}/labels.parquet"))
    w, r = np.zeros(nbsvm.SIZE), np.zeros(nbsvm.SIZE)
    w[model.at], r[model.at] = model.weights, model.scales

    def accepted(text):
        at, v = nbsvm.scaled(nbsvm.extract(text), r)
        return nbsvm.X.sigmoid(model.slope * (w[at] @ v + model.bias) + model.offset) >= nbsvm.CUT

    assert rows("quality:out") == [x for x in rows("quality") if accepted(x[1])]
    assert 0 < len(rows("quality:out")) < len(rows("quality"))
    # exact dedup: of equal texts the longest, then the smallest id
    best = {}
    for x in rows("exact_dedup"):
        key, place = (x[1] or "").translate(WS), (-len(x[1] or ""), x[0] is None, x[0] or 0, repr(x))
        best[key] = min(best.get(key, (place, x)), (place, x), key=lambda p: p[0])
    assert rows("exact_dedup:out") == sorted((x for _, x in best.values()), key=repr)
    # near dedup: the smallest id of each component
    left = rows("near_dedup")
    fp = [fingerprint(x[1]) for x in left]
    comp = list(range(len(left)))
    place = [(x[0] is None, x[0] or 0) for x in left]
    changed = True
    while changed:
        changed = False
        for i in range(len(left)):
            for j in range(len(left)):
                if bin(fp[i] ^ fp[j]).count("1") <= 2 and place[comp[j]] < place[comp[i]]:
                    comp[i], changed = comp[j], True
    assert rows("near_dedup:out") == sorted((left[i] for i in set(comp)), key=repr) and len(set(comp)) < len(left)
    # mix: each source near its target, nothing more than twice, words in order
    before = {x[0]: x for x in rows("mix")}
    size, taken, times = Counter(), Counter(), Counter()
    for x in rows("mix"):
        size[x[3]] += len((x[1] or "").split())
    for x in rows("mix:out"):
        words = iter(before[x[0]][1].split())
        assert all(v in words for v in x[1].split()) and x[4] == len(x[1]) and x[2:4] == before[x[0]][2:4]
        taken[x[3]] += len(x[1].split())
        times[x[0]] += 1
    assert max(times.values()) <= 2
    from tests.llm.test_mixing import reshare
    assert all(abs(taken[s] - t) <= P.BLOCK_WORDS for s, t in reshare(dict(size)).items())
    # tokens: the library's ids, and the bytes come back
    path, pattern = queries.multilingual_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for x in rows("tokenize"):
        ids = np.array(library.encode_ordinary(x[1]), "<u4")
        want.append((x[0], len(ids), ids.tobytes(), hashlib.sha256(x[1].encode()).hexdigest()))
    got = [(a, b, bytes(c), d) for a, b, c, d in map(tuple, inputs["tokenize:out"].collect())]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = [(a, b, bytes(c), d) for a, b, c, d in map(tuple, P.run(spark, folder).collect())]
    assert sorted(whole, key=repr) == sorted(want, key=repr)


def test_stages_take_an_empty_table(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_entry_registers_all_and_nothing_else_imports_the_subpackage():
    import __spark_entry__ as E

    names = E.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    root = os.path.dirname(os.path.abspath(P.__file__))
    for at, _, files in os.walk(os.path.join(root, "docsift")):
        if os.sep + "llm" in at:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "docsift.llm" not in open(os.path.join(at, f)).read(), f
    importlib.reload(P)
