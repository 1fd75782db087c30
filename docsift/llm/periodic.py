"""Periodic runs of words, found by recursive frequency splitting.

A run is a maximal stretch of consecutive words with smallest period q (words
q apart are identical) that is at least ``MIN_WORDS`` words and ``MIN_PERIODS``
periods long. Every word of a run stands in it at least ``MIN_PERIODS`` times.
So a word that occurs less often in its segment (at first the whole text) can
be in no run there, and splits the segment; the parts are counted again, until
no word is too rare. What is left of ordinary prose is nothing.

In the surviving segments every lag q is scanned at the multiples of q: the
stretch of equal words of a run covers two of them in a row, so no run is
missed, and all lags of n words cost n log n comparisons. A place where all
probes agree is extended to the run's ends by comparing words.

Words are numbered by an exact dictionary of the text; no hashes decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import small_batches

MIN_WORDS, MIN_PERIODS = 24, 3
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Probes of a lag scan that are held at once.
PROBES = 1 << 22
_SPACE = b" \t\n\x0b\x0c\r"


def numbered_words(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word's form, the forms); words end at ASCII white space."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        found = text[at:end].split()
        for w in found:
            if w not in numbers:
                numbers[w] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), list(numbers)


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that frequency splitting leaves: at least
    MIN_WORDS long, each of their words at least MIN_PERIODS times in them."""
    pending, done = [(0, len(ids))], []
    while pending:
        rest = []
        for start, end in pending:
            if end - start < MIN_WORDS:
                continue
            part = ids[start:end]
            if end - start == len(ids):
                rare = np.bincount(part)[part] < MIN_PERIODS
            else:
                _, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
                rare = counts[inverse] < MIN_PERIODS
            cuts = np.flatnonzero(rare)
            if not len(cuts):
                done.append((start, end))
                continue
            starts = np.concatenate([[0], cuts + 1])
            ends = np.concatenate([cuts, [end - start]])
            keep = ends - starts >= MIN_WORDS
            rest += zip((starts[keep] + start).tolist(), (ends[keep] + start).tolist())
        pending = rest
    return sorted(done)


def _probes(ids: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) for the lags first..last where the words at place, a multiple of
    the lag, place + 1, the middle and place + lag equal those one lag on."""
    lags = np.arange(first, last + 1)
    each = (len(ids) - 1) // lags - 1  # places with two lags behind them
    lag = np.repeat(lags, each)
    place = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * lag
    for offset in (lambda q: 0, lambda q: q, lambda q: q // 2, lambda q: np.minimum(q, 1)):
        at = place + offset(lag)
        same = ids[at] == ids[at + lag]
        lag, place = lag[same], place[same]
    return lag, place


def _agree(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (step 1) or back (step -1) equal those one lag on."""
    n, width = 0, 64
    limit = len(ids) - lag - at if step > 0 else at + 1
    while n < limit:
        size = min(width, limit - n)
        lo = at + n if step > 0 else at - n - size + 1
        differ = np.flatnonzero(ids[lo:lo + size] != ids[lo + lag:lo + lag + size])
        if len(differ):
            return n + int(differ[0] if step > 0 else size - 1 - differ[-1])
        n, width = n + size, width * 2
    return n


def scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment.

    Lags rise, so a run is first met at its smallest period. A place that lies
    with two lags inside a known run has that run's period as a divisor of the
    lag, and leads to the same run: it is passed over.
    """
    n, found = len(ids), []
    first = 1
    while first <= n // MIN_PERIODS:
        last, size = first, 0
        while last <= n // MIN_PERIODS and (last == first or size + n // last <= PROBES):
            size += n // last
            last += 1
        lag, place = _probes(ids, first, last - 1)
        for q, at in zip(lag.tolist(), place.tolist()):
            if any(s <= at and at + 2 * q < s + length for s, length, _ in reversed(found)):
                continue
            ahead = _agree(ids, at, q, 1)
            if ahead <= q:
                continue
            back = _agree(ids, at - 1, q, -1) if at else 0
            length = back + ahead + q
            if length >= max(MIN_WORDS, MIN_PERIODS * q):
                found.append((at - back, length, q))
        first = last
    return found


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    return sorted(((s + start, length, q) for start, end in segments(ids) for s, length, q in scan(ids[start:end])), key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that are in no run after its first period."""
    stay = np.ones(n, bool)
    for start, length, q in found:
        stay[start + q:start + length] = False
    return stay


def collapsed(ids: np.ndarray, forms: list[bytes], stay: np.ndarray) -> Iterator[bytes]:
    """The kept words with single spaces between, in parts."""
    left = ids[stay]
    for at in range(0, len(left), 1 << 16):
        yield (b" " if at else b"") + b" ".join([forms[i] for i in left[at:at + (1 << 16)].tolist()])


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equal ones
    the first start, then the smallest period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SQL_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _named(r: tuple[int, int, int]) -> dict:
    return {"start": r[0], "length": r[1], "period": r[2]}


def collapse(text: str | None) -> tuple[int, list[dict], dict | None, str]:
    """(number of words, runs, the greatest run, the text without repeats) of one text."""
    ids, forms = numbered_words((text or "").encode())
    found = runs(ids)
    best = greatest(found)
    return len(ids), [_named(r) for r in found], best and _named(best), b"".join(collapsed(ids, forms, kept(len(ids), found))).decode()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then
    period), ``best`` (the run with most periods, or null) and ``collapsed``: the
    words that are in no run after its first period, joined by single spaces. One
    row per input row.

    Null and empty texts have no words, no runs and an empty collapsed text.
    Repeated rows and null ids are passed on as they are, each for itself; other
    columns are ignored; an empty table gives an empty table. A text is taken
    whole, however long: beside it a task holds four bytes a word and each
    distinct word once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                n, found, best, left = zip(*[collapse(t.as_py()) for t in b.column(1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(left, pa.string())],
                                                 names=["doc_id", "n_words", "runs", "best", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{_SQL_RUN}>, best {_SQL_RUN}, collapsed string")
