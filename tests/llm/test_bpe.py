"""BPE ids equal the tiktoken library's; decoding gives the text back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from docsift.llm import bpe
from docsift.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.load_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})

random.seed(5)
TEXTS = ["", "a", " ", "\n\n \t x", "don't we'll I'M it's", "hello world " * 40, "aaaaaaaaaaaaaaaaab" * 30, "ababababcababab" * 50,
         "Ünïcödé 漢字 🙂🙃 ﷽", "<|endoftext|> is text", "x" * 5000, "0123456789" * 300, "é" * 999, "\x00\x1c\x85 ", " " * 4000 + "z",
         "".join(chr(random.choice([*range(32, 127), *range(0xC0, 0x250), *range(0x4E00, 0x4E80)])) for _ in range(5000)),
         "".join(random.choice("abcdefgh") for _ in range(20000))]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_ids_equal_the_library(k):
    enc, dec = bpe.encoder(PATH, PATTERN), bpe.decoder(PATH)
    packed = enc.encode(TEXTS[k])
    assert np.frombuffer(packed, "<u4").tolist() == REFERENCE.encode_ordinary(TEXTS[k])
    assert dec.decode(packed) == TEXTS[k].encode()


def test_piecewise_and_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "PIECEWISE_CHARS", 100)
    monkeypatch.setattr(bpe, "PIECES", 7)
    enc = bpe.Encoder(RANKS, PATTERN, cache=3)
    for t in TEXTS:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == REFERENCE.encode_ordinary(t)
    assert len(enc.new) <= 3 and len(enc.old) <= 3


def test_long_pre_token_is_not_quadratic():
    piece = "".join(random.choice("abc") for _ in range(200_000)).encode()
    ids = bpe.merge(piece, RANKS)
    tokens = {i: t for t, i in RANKS.items()}
    assert b"".join(tokens[i] for i in ids) == piece


def test_query_columns(spark, tmp_dir):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (99, None), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id bigint, text string, ids binary, decoded int").repartition(3)
    df.write.parquet(f"{tmp_dir}/t/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op6_bpe_round_trip"](spark, f"{tmp_dir}/t").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)
    want = []
    for d, t in rows:
        ids = np.array(REFERENCE.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_clashing_column_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, ids int")
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, PATTERN)
    assert bpe.round_trip(df, PATH, PATTERN).count() == 0
