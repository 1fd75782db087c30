"""Hashed text features, label sampling and scoring shared by the classifiers.

Texts are turned into sorted arrays of feature numbers inside Spark tasks. A
model is fitted in one task on a bounded sample of labelled rows and applied to
every row of the table; its weights, at most one per hash bucket, are broadcast.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import small_batches

WORD = regex.compile(r"\w+")
TOKEN = regex.compile(r"[^\W\d_]+|[\d_]+|[^\w\s]+")

#: Shapes of tokens; SAME replaces the shape of a token equal to the one before.
PLAIN, TITLE, UPPER, DIGITS, PUNCTUATION, SAME = range(6)
SHAPES, SHAPE_GRAMS = 6, 4
#: Numbers of all shape n-grams up to SHAPE_GRAMS.
SHAPE_SPACE = sum(SHAPES ** n for n in range(1, SHAPE_GRAMS + 1))


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """Upper ``bits`` of a multiplicative hash."""
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pairs(first: np.ndarray, second: np.ndarray, salt: int) -> np.ndarray:
    return (first * np.uint64(0xD6E8FEB86659FD93) ^ second + np.uint64(salt)) * np.uint64(0xA0761D6478BD642F)


#: First letters of a word that count as its stems.
STEMS = (4, 5, 6)


@lru_cache(maxsize=200_000)
def _word(w: str) -> bytes:
    """The word's CRC-32 and those of its stems (of the word, if it is no longer)."""
    return struct.pack(f"<{1 + len(STEMS)}Q", zlib.crc32(w.encode()), *[zlib.crc32(w[:n].encode()) | n << 40 for n in STEMS])


def skip_grams(text: str | None, bits: int) -> np.ndarray:
    """Distinct numbers of the lower-cased words, their stems, word pairs, and
    pairs with one word between; empty for a text without words."""
    words = WORD.findall((text or "").lower())
    h = np.frombuffer(b"".join(map(_word, words)), "<u8").reshape(-1, 1 + len(STEMS))
    first = h[:, 0]
    return np.unique(mixed(np.concatenate([(h + np.uint64(1 << 32)).ravel(), pairs(first[:-1], first[1:], 1), pairs(first[:-2], first[2:], 2)]), bits))


@lru_cache(maxsize=100_000)
def _token(t: str) -> int:
    """The token's CRC-32, and its shape above."""
    if t[0].isalpha():
        shape = UPPER if len(t) > 1 and t.isupper() else TITLE if t[0].isupper() else PLAIN
    else:
        shape = DIGITS if t[0].isdigit() or t[0] == "_" else PUNCTUATION
    return zlib.crc32(t.encode()) | shape << 32


def token_grams(text: str | None, bits: int) -> np.ndarray:
    """Distinct numbers of tokens (words, digit runs, punctuation runs), token
    pairs, and, from 2**bits on, n-grams of token shapes."""
    tokens = TOKEN.findall(text or "")
    packed = np.fromiter(map(_token, tokens), np.uint64, len(tokens))
    h, shape = packed & np.uint64(0xFFFFFFFF), (packed >> np.uint64(32)).astype(np.int64)
    shape[1:][h[1:] == h[:-1]] = SAME
    found = [mixed(np.concatenate([h + np.uint64(1 << 32), pairs(h[:-1], h[1:], 1)]), bits)]
    at, gram = 1 << bits, np.zeros(len(shape), np.int64)
    for n in range(1, SHAPE_GRAMS + 1):
        gram = gram[:len(shape) - n + 1] * SHAPES + shape[n - 1:] if len(shape) >= n else gram[:0]
        found.append(at + np.flatnonzero(np.bincount(gram, minlength=1)))
        at += SHAPES ** n
    return np.unique(np.concatenate(found))


def featured(texts: DataFrame, extract: Callable[[str | None], np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``texts``, and ``x``: the feature numbers of ``text`` as packed 32-bit integers."""
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                x = [extract(t.as_py()).astype("<u4").tobytes() for t in b.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(x, pa.binary())], names=[*keep, "x"])

    return small_batches(texts).select(*keep, "text").mapInArrow(run, ", ".join([f"{c} {fields[c]}" for c in keep] + ["x binary"]))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int, seed: int,
                    extract: Callable[[str | None], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``order``, ``y`` (0/1), ``x`` (packed feature numbers) of at most ``most``
    labelled ids outside the held-out fold: crc32 of the id as text modulo
    ``fold[0]`` is not ``fold[1]``.

    Ids are taken in the order of a hash of them, each once: of several labels the
    more frequent counts (1 if they are as many), of several documents the one with
    the least hash of its text. Null ids, labels and other label values than 0 and 1
    are left out. So the sample is the same however the tables are partitioned, and
    repeated rows don't crowd others out.
    """
    voted = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), fold))
             .groupBy(F.col("doc_id").alias("_id")).agg((F.avg(F.col(label).cast("int")) >= 0.5).cast("int").alias("y")))
    chosen = voted.select("_id", "y", F.xxhash64(F.lit(seed), F.col("_id")).alias("order")).orderBy("order", "_id").limit(most)
    # the broadcast side has at most ``most`` rows of three numbers
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).withColumn("h", F.xxhash64("text"))
    # features are extracted where the texts are read; a repeated row leaves one a task
    return (featured(found, extract, ["_id", "order", "y", "h"]).groupBy("_id", "order", "y").agg(F.min(F.struct("h", "x")).alias("least"))
            .select("order", "y", "least.x"))


def held_out(doc_id, fold: tuple[int, int]):
    """Whether the id is in the held-out fold; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % fold[0] == fold[1], F.lit(False))


def fit_in_task(sample: DataFrame, fit: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Run ``fit(xs, y)`` on the featured sample (order, y, x) in one task; its
    non-zero weights (numbers, values) and other parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, y, x) for b in batches for o, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        at, w, rest = fit([np.frombuffer(x, "<u4").astype(np.int64) for _, _, x in rows], np.array([y for _, y, _ in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(at, "<i4").tobytes()]), pa.array([np.asarray(w, "<f4").tobytes()]), pa.array([list(map(float, rest))])],
                                         names=["at", "w", "rest"])

    row = sample.repartition(1).mapInArrow(run, "at binary, w binary, rest array<double>").first()
    if row is None:  # no partition at all: an empty table
        at, w, rest = fit([], np.zeros(0, np.int64))
        return np.asarray(at, np.int32), np.asarray(w, np.float32), list(rest)
    return np.frombuffer(row["at"], "<i4"), np.frombuffer(row["w"], "<f4"), list(row["rest"])


def scored(docs: DataFrame, score: Callable[[str | None], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def accepted(docs: DataFrame, accept: Callable[[str | None], bool], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([accept(t.as_py()) for t in b.column(at)], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))
