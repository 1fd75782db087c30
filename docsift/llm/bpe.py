"""Byte-level BPE with a hierarchical-bitmap rank queue.

The bytes of pre-tokens are a linked list. Every adjacent pair that the vocabulary
can merge waits in the bucket of its merge rank, as the list position of its
left part. A two-level bitmap marks the buckets in use: find-first-set on the
summary and then on one word gives the lowest rank in constant time, whatever
the pre-token's length. A bucket gives its leftmost position first; an entry
whose parts have changed meanwhile is stale and is skipped. n bytes cost
O(n log n) at worst, where a scan for the lowest rank costs O(n^2). Unknown
pre-tokens of some texts share one list and queue, without pairs across their bounds.

Ids are kept as little-endian unsigned 32-bit integers, the form of token files.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import small_batches

WORD = 64
#: Encoded pre-tokens that a worker keeps, in two generations.
CACHE = 400_000
#: Longer pre-tokens are encoded each time they occur.
CACHED_CHARS = 64
#: Texts beyond this many characters are split into pre-tokens piecewise, to bound memory.
PIECEWISE_CHARS, PIECES = 1 << 20, 1 << 16
#: Texts are encoded together up to this many characters.
GROUP_CHARS = 1 << 19
#: Pre-tokens that share a rank queue; more would leave the processor's cache.
TOGETHER = 2000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with the arrays that start a merge: the rank of every byte and of
    every pair of bytes (-1: none)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = max(ranks.values(), default=0) // WORD + 1
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.of_pair = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_pair[token[0] << 8 | token[1]] = rank


def merge_all(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Packed ids of each pre-token: always its pair of the lowest rank, leftmost first.

    The pre-tokens lie end to end in one linked list and share one rank queue; no
    pair reaches over the start of a pre-token, so each is merged in its own order.
    ``end[i]`` is where the part that starts at i ends, so also where the next part
    starts (0: no part starts here any more); ``before[i]`` is the start of the part
    before, ``pair[i]`` the rank of the part at i with the next one (-1: none),
    ``token[i]`` its id. ``buckets[rank]`` is a heap of positions, ``words`` has the
    bits of the ranks in use and ``summary`` those of the words in use.
    """
    ranks, get = vocabulary.ranks, vocabulary.ranks.get
    data = b"".join(pieces)
    n = len(data)
    if not n:
        return [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    stops = np.cumsum(lengths)
    starts = np.zeros(n + 1, np.uint8)
    starts[stops - lengths] = starts[n] = 1
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    first = np.full(n, -1, np.int64)
    first[:-1] = np.where(starts[1:n], -1, vocabulary.of_pair[raw[:-1] << 8 | raw[1:]])
    begins, pair, token = starts.tobytes(), first.tolist(), vocabulary.of_byte[raw].tolist()
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = np.argsort(first, kind="stable")
    at = at[np.searchsorted(first[at], 0):]
    values, cuts = np.unique(first[at], return_index=True)
    buckets = {r: p.tolist() for r, p in zip(values.tolist(), np.split(at, cuts[1:]))}  # rising, so heaps
    words, summary = [0] * vocabulary.words, 0
    for rank in buckets:
        words[rank // WORD] |= 1 << rank % WORD
        summary |= 1 << rank // WORD
    while summary:
        w = (summary & -summary).bit_length() - 1
        low = words[w] & -words[w]
        rank = w * WORD + low.bit_length() - 1
        bucket, lower = buckets[rank], False
        while bucket and not lower:
            i = heappop(bucket)
            if pair[i] != rank:
                continue  # stale: one of the parts has grown since
            j = end[i]
            end[i] = k = end[j]
            end[j], pair[j], pair[i], token[i] = 0, -1, -1, rank
            if not begins[k]:
                before[k] = i
                r = get(data[i:end[k]])
                if r is not None:
                    pair[i] = r
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        words[r // WORD] |= 1 << r % WORD
                        summary |= 1 << r // WORD
                    lower = r < rank
            if not begins[i]:
                h = before[i]
                pair[h] = r = get(data[h:k], -1)
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        words[r // WORD] |= 1 << r % WORD
                        summary |= 1 << r // WORD
                    lower |= r < rank
        if not bucket:
            del buckets[rank]
            words[w] ^= low
            if not words[w]:
                summary ^= 1 << w
    parts = np.flatnonzero(np.array(end))
    ids = np.array(token)[parts]
    if (ids < 0).any():
        raise KeyError("a byte that the vocabulary does not hold")
    packed = ids.astype("<u4").tobytes()
    upto = [0, *(4 * np.searchsorted(parts, stops)).tolist()]
    return [packed[a:b] for a, b in zip(upto, upto[1:])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    return np.frombuffer(merge_all([piece], Vocabulary(ranks))[0], "<u4").tolist()


class Encoder:
    """Text -> packed ids, pre-token by pre-token, with a two-generation cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.vocabulary, self.pattern, self.cache = Vocabulary(ranks), regex.compile(pattern), cache
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Pre-tokens that are not kept yet are merged
        together; long texts go through by themselves, in pieces."""
        found = [self.pattern.findall(t) if len(t) <= PIECEWISE_CHARS else None for t in texts]
        packed = self._packed([p for pieces in found if pieces for p in pieces])
        out, at = [], 0
        for text, pieces in zip(texts, found):
            if pieces is None:
                out.append(self._piecewise(text))
            else:
                out.append(b"".join(packed[at:at + len(pieces)]))
                at += len(pieces)
        return out

    def _piecewise(self, text: str) -> bytes:
        out, pieces = [], []
        for m in self.pattern.finditer(text):
            pieces.append(m.group())
            if len(pieces) >= PIECES:
                out += self._packed(pieces)
                pieces = []
        return b"".join([*out, *self._packed(pieces)])

    def _packed(self, pieces: list[str]) -> list[bytes]:
        packed = list(map(self.new.get, pieces))
        if None not in packed:
            return packed
        unknown = list(dict.fromkeys(p for p, ids in zip(pieces, packed) if ids is None))
        found = dict(zip(unknown, map(self.old.get, unknown)))
        fresh, whole = [], self.vocabulary.ranks.get
        for p in unknown:
            if found[p] is None:
                raw = p.encode()
                rank = whole(raw)
                if rank is None:
                    fresh.append((p, raw))
                else:
                    found[p] = struct.pack("<I", rank)
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at:at + TOGETHER]
            found.update(zip([p for p, _ in some], merge_all([raw for _, raw in some], self.vocabulary)))
        for p, ids in found.items():
            if len(p) <= CACHED_CHARS:
                if len(self.new) >= self.cache:
                    self.old, self.new = self.new, {}
                self.new[p] = ids
        return [found[p] if ids is None else ids for p, ids in zip(pieces, packed)]


class Decoder:
    """Packed ids -> bytes: the tokens' bytes lie end to end in one array, and the
    bytes of many ids are picked from it at once."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.all = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _part(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.all[np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - length), length)].tobytes()

    def decode(self, packed: bytes) -> bytes:
        step = 4 * PIECES
        return b"".join([self._part(np.frombuffer(packed[at:at + step], "<u4")) for at in range(0, len(packed), step)])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary file, made once."""
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def _mapped(df: DataFrame, column: str, out: list[str], apply, keep: list[str] | None = None, bytes_a_batch: int = 4 << 20) -> DataFrame:
    """Columns ``keep`` (default: all) of ``df`` and the binary columns ``out``, the
    values of ``apply(values of column)``, one list for each, in small batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    keep = df.columns if keep is None else keep
    df = df.select(*keep, F.col(column).alias("_in"))
    schema = StructType([*df.schema.fields[:-1], *[StructField(o, BinaryType()) for o in out]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, made, size, group, chars = 0, [[] for _ in out], 0, [], 0
            for i, x in enumerate(b.column(len(keep))):
                group.append(x.as_py())
                chars += len(group[-1] or "")
                last = i + 1 == b.num_rows
                if chars < GROUP_CHARS and not last:
                    continue
                for column, values in zip(made, apply(group)):
                    column += values
                    size += sum(map(len, values))
                group, chars = [], 0
                if size >= bytes_a_batch or last:
                    kept = [c.slice(first, len(made[0])).cast(t) for c, t in zip(b.columns[:len(keep)], arrow.types)]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.binary()) for c in made)], names=arrow.names)
                    first, made, size = i + 1, [[] for _ in out], 0

    return small_batches(df).mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the packed ids of every whole text.

    ``vocabulary`` is a rank file's path that every worker can open. A null or
    empty text gives no ids. Special tokens in a text are ordinary text. ``out``
    must not be a column of ``df`` (ValueError); any others are passed on.
    """
    if out in df.columns:
        raise ValueError(f"column {out} is there already")
    return _mapped(df, text_col, [out], lambda texts: [encoder(vocabulary, pattern).encode_all([t or "" for t in texts])])


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes of the packed ids (null: none), which are
    the UTF-8 of the text that was encoded."""
    if out in df.columns:
        raise ValueError(f"column {out} is there already")
    return _mapped(df, ids_col, [out], lambda ids: [[decoder(vocabulary).decode(p or b"") for p in ids]])


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (from the ids alone) of every row (repeated
    rows too); other columns are left out, an empty table gives an empty table. A
    row meets Python once, and its text doesn't come back."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def both(texts: list[str | None]) -> list[list[bytes]]:
        ids = encoder(vocabulary, pattern).encode_all([t or "" for t in texts])
        return [ids, [decoder(vocabulary).decode(i) for i in ids]]

    return _mapped(rows, "text", ["ids", "decoded"], both, keep=["doc_id"])
