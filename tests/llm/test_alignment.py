"""Alignments equal a plain walk over whole encodings; corpus counts equal a slow count."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import tokenizers

from docsift.llm import alignment
from docsift.llm.queries import QUERIES, paired_vocabularies

A_PATH, B_PATH = paired_vocabularies()
A = tokenizers.Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LETTERS = alignment.byte_letters()

random.seed(13)
STRANGE = [*"abc XYZ  \n\t\r0123456789.,;:!?'\"-_()[]{}<>|/\\", "é", "ß", "漢", "字", "🙂", "▁", " ", "\x1c", "\x85", "\x00", "ﬁ", "Á", "½", "　", "​", "'s", " the", "  ", " <|endoftext|>", "<unk>", "</s>", "<0x41>"]
TEXTS = ["", " ", "  ", "\n", "a", " a", "a ", "a  ", "x \n y", "hello world", "don't we'll I'M it's", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "Ünïcödé 漢字 🙂🙃 ﷽ \x00 \x1c",
         "x" * 500, "aaaa" * 300, " " * 300, "ab " * 200, "word\n\nnext   line\tand tab ", "the cat sat on the mat " * 20,
         *("".join(random.choices(STRANGE, k=random.randrange(1, 60))) for _ in range(300))]
TEXTS += [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()]


def bytes_a(i):
    return bytes(LETTERS[c] for c in A.id_to_token(i))


def bytes_b(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def slow(text):
    """(a, b, groups) of a text by whole encodings."""
    if not text:
        return [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + text).encode():
        return [], [], []
    ends = []
    for ids, size in ((a, bytes_a), (b, bytes_b)):
        at, found = 0, []
        for i in ids:
            at += len(size(i))
            found.append(at)
        ends.append(found)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def text_of(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


ONE = alignment.Aligner(A_PATH, B_PATH)


def by_text(one, texts):
    """(n_a, n_b, n_groups, n_links, groups, {pair: n}) of each text, as one batch."""
    made = one.align(texts)
    links = [{} for _ in texts]
    for pair, n, of in zip(made["pair"].tolist(), made["n"].tolist(), made["of"].tolist()):
        assert pair not in links[of]
        links[of][pair] = n
    return list(zip(*(made[k].tolist() for k in ("n_a", "n_b", "n_groups", "n_links")), made["groups"], links))


def slow_row(t):
    a, b, groups = slow(t)
    links = Counter(p << 32 | q for x, y in groups for p in x for q in y)
    return len(a), len(b), len(groups), sum(links.values()), text_of(groups), dict(links)


WANT = [slow_row(t) for t in TEXTS]


def test_equals_whole_encodings_in_batches_and_alone():
    assert ONE.cuts and by_text(ONE, TEXTS) == WANT
    for t, row in zip(TEXTS, WANT):
        assert by_text(ONE, [t]) == [row], repr(t)
    assert by_text(ONE, ["", "▁"]) == [slow_row(""), slow_row("▁")]


def test_ranks_give_the_ids_of_the_file():
    for t in TEXTS:
        assert list(ONE.ids_a(" " + t)) == A.encode(" " + t, add_special_tokens=False).ids, repr(t)


def test_small_store_and_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 9)
    monkeypatch.setattr(alignment, "CROWD", 2)
    small = alignment.Aligner(A_PATH, B_PATH, cache=3)
    for at in range(0, len(TEXTS), 7):
        assert by_text(small, TEXTS[at:at + 7]) == WANT[at:at + 7]
    assert max(len(small.windows.new), len(small.windows.old)) <= 3


def test_anchors_are_shared_ends_before_spaces():
    a, b = ONE.encode(TEXTS[-1])
    at_a, at_b = ONE.anchors(a, b, np.array([0]))
    assert len(at_a) == len(at_b) > 20 and (at_a[0], at_b[0]) == (0, 0)
    for i, j in zip(at_a[1:].tolist(), at_b[1:].tolist()):
        assert ONE.of_a.joined(a[:i]) == ONE.of_b.joined(b[:j]) and ONE.of_a.tokens[a[i]].startswith(b" ")


def test_equal_windows_are_decided_by_ids(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 4000), rng.integers(0, 2, 4000)
    at = np.sort(rng.choice(np.arange(1, 4000), 1500, replace=False))
    at = np.append([0], at)
    end = np.append(at[1:], 4000)
    keys = [(tuple(a[i:k]), tuple(b[i:k])) for i, k in zip(at, end)]

    def classes():
        like = alignment.equal_windows(a, at, end, b, at, end)
        assert all(keys[i] == keys[j] for i, j in enumerate(like.tolist()))
        return like.tolist()

    assert len(set(classes())) == len(set(keys))
    monkeypatch.setattr(alignment, "_hashes", lambda ids, start, end: np.zeros(len(start), np.uint64))  # all collide
    classes()


def test_other_normalizers_are_not_cut(tmp_path):
    import json

    with open(A_PATH, encoding="utf-8") as f:
        made = json.load(f)
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "a.json").write_text(json.dumps(made), encoding="utf-8")
    other = alignment.Aligner(str(tmp_path / "a.json"), B_PATH)
    assert not other.cuts and by_text(other, TEXTS[:60]) == WANT[:60]  # a space is there already


def expected(rows):
    found = [(d, *slow(t or "")) for d, t in rows]
    held = Counter(pair for *_, groups in found for pair in {(p, q) for x, y in groups for p in x for q in y})
    most = {}
    for (p, _), n in held.items():
        most[p] = max(n, most.get(p, 0))
    out = []
    for d, a, b, groups in found:
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        best = sum(n for pair, n in links.items() if held[pair] == most[pair[0]])
        out.append((d, len(a), len(b), len(groups), sum(links.values()), best, sum(n * held[pair] for pair, n in links.items()),
                    hashlib.sha256(text_of(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1 << 20, 50, 0])
def test_query_columns(spark, tmp_dir, monkeypatch, hot):
    monkeypatch.setattr(alignment.rate, "__defaults__", (hot,))
    rows = [*enumerate(TEXTS), (None, "null id"), (9000, None), (5, "twice over"), (5, "twice over")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, groups string, links int").repartition(3)
    df.write.parquet(f"{tmp_dir}/t/documents.parquet")
    got = QUERIES["op13_token_alignment"](spark, f"{tmp_dir}/t")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_hot_threshold(spark):
    counts = spark.createDataFrame([(i, h, True) for i, h in enumerate([1] * 10 + [2, 3] * 3 + [4, 9, 700])], "pair bigint, held bigint, best boolean")
    assert [alignment.hot_from(counts, n) for n in (100, 19, 18, 9, 8, 3, 1, 0)] == [1, 1, 2, 2, 4, 4, 512, 1 << 62]


def test_empty_table_and_taken_columns(spark):
    df = spark.createDataFrame([], "doc_id string, text string, row int")
    assert alignment.rate(alignment.align(df, A_PATH, B_PATH)).count() == 0
    with pytest.raises(ValueError):
        alignment.rate(alignment.align(df, A_PATH, B_PATH).withColumnRenamed("n_a", "row"))
