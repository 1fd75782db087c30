"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit SimHashes of word shingles. Equal ones are collapsed
first. The rest is a binary trie over the bits; two trie nodes are traversed
together, the bits in which their paths differ are added up, and a node pair is
dropped as soon as the sum exceeds the budget. The search is exhaustive: no
candidate limit, no bucket cap.

Distribution: the top ``k`` levels of the trie are cells. A cell meets only the
cells whose prefix differs in at most ``max_bits`` bits, so a fingerprint (8
bytes) goes to its own cell and to the smaller-numbered cells near it, at most
1 + k + k(k-1)/2 for two bits. ``k`` grows with the number of fingerprints so
that a cell holds about ``CELL`` of its own. Bits are taken in the order of how
evenly they split the corpus, so that cells stay even.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import content_key, materialize, one_row_each, small_batches
from docsift.llm.components import connected_components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
#: Own fingerprints that a cell of the top trie levels should hold.
CELL = 4096
#: Trie node pairs expanded at a time (bounds a task's memory).
FRONTIER = 1 << 18
#: Node pairs of at most this many fingerprint pairs are compared directly.
LEAF_PAIRS = 16

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhash(text: str | None, n: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text: A-Z lower-cased, words by white space, word
    ``n``-shingles with repeats (fewer words: all of them as one; none: 0)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    m = max(1, len(words) - n + 1)
    ends = starts[len(words) - m + 1:] - 1
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:m].tolist(), ends.tolist())])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)  # digests are big-endian
    for at in range(0, m, 16384):
        ones += np.unpackbits(rows[at:at + 16384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``key`` (hash of id and text), ``fp`` (64 bits), one row per
    input row; a null text counts as empty, whose fingerprint is zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle_words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, key bigint, fp bigint")


def bit_order(fps: DataFrame) -> list[int]:
    """The 64 bit numbers, the most evenly split bit first (one aggregate)."""
    row = fps.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]).first()
    return sorted(range(64), key=lambda i: (abs(2 * (row[f"b{i}"] or 0) - row.n), i))


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """The fingerprints with bit ``order[0]`` as the highest, and so on."""
    out = np.zeros_like(fp)
    for to, at in enumerate(order):
        out |= ((fp >> np.uint64(at)) & np.uint64(1)) << np.uint64(63 - to)
    return out


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, member) for the members of ranges [lo, hi)."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def trie_pairs(own: np.ndarray, every: np.ndarray, max_bits: int, from_bit: int = 63) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of ``own``, j of ``every``) at most ``max_bits`` apart.

    Both arrays are sorted and distinct; a trie node is a range of them. The
    frontier of node pairs is taken from a stack in parts of ``FRONTIER``.
    """
    if not len(own) or not len(every):
        return
    stack = [(from_bit, *(np.array([x], np.int64) for x in (0, len(own), 0, len(every), 0)))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            for at in range(0, len(a0), FRONTIER):
                stack.append((bit, *(x[at:at + FRONTIER] for x in (a0, a1, b0, b1, err))))
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            owner, i = _expand(a0[small], a1[small])
            at, j = _expand(b0[small][owner], b1[small][owner])
            i = i[at]
            near = np.bitwise_count(own[i] ^ every[j]) <= max_bits
            if near.any():
                yield i[near], j[near]
        a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        # the first member of each range whose bit is 1
        am, bm = _split(own, a0, a1, bit), _split(every, b0, b1, bit)
        parts = []
        for x0, x1, y0, y1, cost in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            e = err + cost
            live = (x0 < x1) & (y0 < y1) & (e <= max_bits)
            parts.append([x[live] for x in (x0, x1, y0, y1, e)])
        merged = [np.concatenate(x) for x in zip(*parts)]
        if len(merged[0]):
            stack.append((bit - 1, *merged))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where bit ``bit`` becomes 1 in each range (all higher bits are equal there)."""
    prefix = (values[lo] >> np.uint64(bit + 1)) << np.uint64(bit + 1) if bit < 63 else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(values, prefix | _BITS[bit]), lo, hi)


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a < b`` (as bigint): all pairs of the distinct fingerprints ``fps.fp``
    that differ in 1 to ``max_bits`` bits. Cells are joined as described above;
    a pair comes from the smaller cell alone."""
    n = fps.count()
    k = max(6, min(16, int(np.ceil(np.log2(max(n, 1) / CELL)))))
    order = bit_order(fps)
    masks = [sum(1 << x for x in c) for m in range(1, min(max_bits, k) + 1) for c in combinations(range(k), m)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                fp = b.column(0).to_numpy().view(np.uint64)
                p = permuted(fp, order)
                home = (p >> np.uint64(64 - k)).astype(np.int64)
                cells, rows = [home], [p]
                for m in masks:
                    near = home ^ m
                    down = near < home
                    cells.append(near[down])
                    rows.append(p[down])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(rows).view(np.int64))], names=["cell", "p"])

    back = [63 - order.index(i) for i in range(64)]  # permuted place of bit i

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p = np.sort(table.column("p").to_numpy().view(np.uint64))
        cell = np.uint64(key[0].as_py())
        own = p[(p >> np.uint64(64 - k)) == cell]
        first = np.searchsorted(p, own[0]) if len(own) else 0
        found = []
        for i, j in trie_pairs(own, p, max_bits):
            later = (j > first + i) | (j < first)  # own pairs once; a fingerprint of another cell always
            found.append((own[i[later]], p[j[later]]))
        x, y = (np.concatenate(z) if found else np.zeros(0, np.uint64) for z in (zip(*found) if found else ((), ())))
        x, y = _unpermuted(x, back), _unpermuted(y, back)
        return pa.table({"a": pa.array(np.minimum(x.view(np.int64), y.view(np.int64))), "b": pa.array(np.maximum(x.view(np.int64), y.view(np.int64)))})

    cells = fps.select("fp").mapInArrow(place, "cell bigint, p bigint")
    return cells.groupBy("cell").applyInArrow(join, "a bigint, b bigint")


def _unpermuted(p: np.ndarray, back: list[int]) -> np.ndarray:
    out = np.zeros_like(p)
    for i, at in enumerate(back):
        out |= ((p >> np.uint64(at)) & np.uint64(1)) << np.uint64(i)
    return out


def _components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, fp; placed: fp, doc_id (its smallest), root: a
    fingerprint that stands for the component)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    links = materialize(near_pairs(least, max_bits), "simhash-links")
    root = connected_components(links)  # node, root: linked fingerprints only
    placed = least.join(root, least.fp == root.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    return rows, materialize(placed, "simhash-placed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Components of documents whose fingerprints are linked; one row per input row.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``,
    the smallest id reachable over links (null ids count only where a component
    has no other). Null and empty texts share the fingerprint zero and are
    linked like any other; repeated rows share their component. Other columns
    are ignored; an empty table gives an empty table.
    """
    rows, placed = _components(docs, id_col, text_col, shingle_words, max_bits)
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = materialize(placed.join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (all columns) with one row left of each component: the smallest
    id, nulls last, then the smallest hash of the text; of repeated rows one."""
    rows, placed = _components(docs, id_col, text_col, shingle_words, max_bits)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key"))
    # counted before the components are joined, so that copies are one row
    names = rows.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")).select("fp", F.struct(row.alias("at"), F.col("n")).alias("best"))
    names = materialize(names.groupBy("fp").agg(F.min("best").alias("best")), "simhash-best")
    chosen = names.join(placed.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("b"))
    chosen = materialize(chosen.select(F.col("b.at.doc_id").alias("id"), F.col("b.at.key").alias("key"), F.col("b.n").alias("n")), "simhash-chosen")
    return one_row_each(docs, chosen, id_col, text_col)
