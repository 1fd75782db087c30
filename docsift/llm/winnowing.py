"""Document fingerprints by winnowing.

The hashes of all k-grams of a text's code points are rolled over the text; of
every window of ``w`` hashes in a row the least is chosen, the rightmost where
several are least, and kept with its position. So two texts that share any
``k + w - 1`` characters in a row share a hash at the same offset in them (the
match guarantee), nothing shorter than ``k`` is ever matched, and about 2 of
``w + 1`` positions are kept.

Fingerprints are computed inside Spark tasks in blocks, so a text of any length
needs a bounded amount beside it. To compare each document with the next one in
the order of ids, documents meet in ranges of the ids; a range is a sorted
stream, which also gets the first document of the range after it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import let, materialize, scale_partitions, small_batches, text_of
from docsift.operators.numbering import with_position

#: Characters in a gram, and grams in a window: any 64 shared characters are found.
GRAM, WINDOW = 24, 41
#: Windows that are hashed at once, and most characters that they may need beyond.
BLOCK, SPARE = 1 << 18, 1024
#: Marks in a batch that a task returns.
OUT_MARKS = 1 << 17
#: Characters in a range of documents, and most ranges: a boundary each is known to the driver.
RANGE_CHARS, MOST_RANGES = 128 << 20, 8192

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK + SPARE)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), BLOCK + SPARE)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each ``k`` code points in a row: sum of point * base^offset
    modulo 2^64, rolled as a difference of prefix sums, then mixed."""
    n = len(points) - k + 1
    upto = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _UP[:len(points)], out=upto[1:])
    h = (upto[k:] - upto[:-k]) * _DOWN[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def least_rightmost(h: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each ``w`` hashes in a row is, the rightmost of equals."""
    at, width = np.arange(len(h)), 1
    while width < w:
        step = min(width, w - width)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(h[left] < h[right], left, right)
        width += step
    return at


def winnow(text: str | None, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as signed 64-bit numbers, positions) of the fingerprint, by position.

    A text with fewer than ``w`` grams is one window; one with fewer than ``k``
    characters is one gram; the empty text has no fingerprint.
    """
    if k + w > SPARE:
        raise ValueError(f"gram and window together may be at most {SPARE} characters")
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, n)
    w = min(w, n - k + 1)
    hashes, places, last = [], [], -1
    for first in range(0, n - k - w + 2, BLOCK):  # the windows first .. first + BLOCK - 1
        part = points[first:first + BLOCK + k + w - 2]
        h = gram_hashes(part, k)
        at = least_rightmost(h, w)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[at + first > last]
        if len(at):
            hashes.append(h[at])
            places.append(at + first)
            last = places[-1][-1]
    return np.concatenate(hashes).view(np.int64), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Distinct hashes that two fingerprints share, of all that either has; two
    empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


_MARK = pa.struct([("hash", pa.int64()), ("pos", pa.int64())])
_SQL_MARKS = "array<struct<hash:bigint,pos:bigint>>"


def _marks(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """list<struct<hash, pos>> of fingerprints."""
    ends = np.cumsum([0, *(len(h) for h, _ in found)]).astype(np.int32)
    flat = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], fields=list(_MARK)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` (array of hash and pos, by pos),
    one row per input row.

    Null texts count as empty and have an empty fingerprint. Repeated rows and
    null ids are passed on as they are; other columns are ignored; an empty table
    gives an empty table. Equal texts have equal fingerprints.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 128) for at in range(0, whole.num_rows, 128)):
                texts = b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), _marks([winnow(t, k, w) for t in texts])],
                                                 names=["doc_id", "n_chars", "fingerprint"])

    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint {_SQL_MARKS}")


def printed(marks: Column) -> Column:
    """A fingerprint as text: ``hash:pos``, the hash as 16 hex digits, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.concat(F.lpad(F.lower(F.hex(m["hash"])), 16, "0"), F.lit(":"), m["pos"].cast("string"))), ",")


@dataclass
class Ranges:
    """How documents meet: ``starts``, the least key (id, h) of each range but the
    first; ``lent`` (id, h, label), the keys whose text another label needs as its
    last; ``hot`` (id, h, n, base), keys with too many rows for one label, which
    take ``n - 1`` labels from ``base`` on beside that of their range."""

    starts: list
    lent: list
    hot: list
    n_labels: int


def ranges(rows: DataFrame, range_chars: int) -> Ranges:
    """Ranges of the distinct (id, h) of ``rows``, from their counts alone. The
    driver gets a few keys for each range, at most MOST_RANGES of them."""
    light = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    placed = with_position(light, ["id", "h"])
    total = placed.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), F.sum("chars").alias("chars")).first()
    if not total.keys:
        return Ranges([], [], [], 1)
    wanted = max(scale_partitions(rows.sparkSession), total.chars // range_chars)
    n = int(min(wanted, MOST_RANGES, total.keys))
    size = -(-total["keys"] // n)  # keys in a range
    crowd = max(2, -(-total.rows // n))  # rows of one key beyond which it takes several labels
    # boundary keys, and hot keys with the key before them (the next one in descending order)
    near = placed.filter((F.col("pos") % size == 0) | ((F.col("pos") + 1) % size == 0) | (F.col("pos") == total["keys"] - 1))
    hot_at = [r.pos for r in placed.filter(F.col("n") > crowd).select("pos").collect()]
    found = {r.pos: r for r in near.unionByName(placed.filter(F.col("pos").isin([p for q in hot_at for p in (q, q - 1)]))).collect()} if hot_at \
        else {r.pos: r for r in near.collect()}
    last = total["keys"] - 1
    n_ranges = -(-total["keys"] // size)
    starts = [found[c * size] for c in range(1, n_ranges)]
    lent = [(found[c * size - 1 if c else last], c) for c in range(n_ranges)]
    hot, label = [], n_ranges
    for pos in hot_at:
        shares = -(-found[pos].n // crowd)
        before = found[pos - 1 if pos else last]
        lent += [(before, label + i) for i in range(shares - 1)]
        hot.append((found[pos], shares, label))
        label += shares - 1
    return Ranges([(r.id, r.h) for r in starts], [(r.id, r.h, c) for r, c in lent], [(r.id, r.h, s, b) for r, s, b in hot], label)


def _range_of(starts: list, id_type: str) -> Column:
    """How many range starts are at or below (id, h): counted among every ``step``-th
    of them first, then among those between two."""
    if not starts:
        return F.lit(0).cast("long")
    step = max(1, int(len(starts) ** 0.5))
    key = F.struct("id", "h")

    def known(keys: list) -> Column:
        return F.from_json(F.lit(json.dumps([{"id": i, "h": h} for i, h in keys])), f"array<struct<id:{id_type},h:bigint>>")

    def below(keys: Column) -> Column:
        return F.size(F.filter(keys, lambda s: s <= key))

    steps = below(known(starts[step - 1::step]))
    return let(steps, lambda c: c * step + below(F.slice(known(starts), c * step + 1, F.lit(step - 1)))).cast("long")


def _edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Each document's fingerprint beside that of the next document, in the order of
    descending ids, and beside that of its own edited text, whose last third is
    replaced by the start of the next document: ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (arrays of hash and
    pos), ``near_edited``, ``near_next``; one row per input row.

    Null ids come last, rows with the same id in the order of a hash of their text,
    descending; after the last document comes the first. Rows alike in id and text
    are one document: they get the same result. A document without another is its
    own next one. Null texts count as empty; the likeness of two empty texts is 1.
    Other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    spark = docs.sparkSession
    plan = ranges(rows, range_chars)
    key = f"id {kind}, h bigint"

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))

    own = rows.withColumn("label", _range_of(plan.starts, kind))
    if plan.hot:
        # at most one row for each range, as a hot key has more rows than a range holds
        hot = spark.createDataFrame(plan.hot, f"{key}, n bigint, base bigint")
        share = F.pmod(F.spark_partition_id(), F.col("hot.n"))
        own = (own.alias("own").join(F.broadcast(hot).alias("hot"), same("own", "hot"), "left")
               .select("own.id", "own.text", "own.h", F.when(share > 0, F.col("hot.base") + share - 1).otherwise(F.col("own.label")).alias("label")))
    # one text for each range and each further label of a hot key
    wanted = spark.createDataFrame(plan.lent, f"{key}, label bigint")
    distinct = F.broadcast(wanted.select("id", "h").distinct())
    texts = (rows.alias("own").join(distinct.alias("lent"), same("own", "lent"), "left_semi")
             .groupBy("id", "h").agg(F.first("text").alias("text")))
    texts = materialize(texts, "winnow-lent")
    lent = texts.alias("own").join(F.broadcast(wanted).alias("lent"), same("own", "lent")).select("own.id", "own.text", "own.h", "lent.label")
    met = (own.withColumn("lent", F.lit(False)).unionByName(lent.withColumn("lent", F.lit(True)))
           .repartitionById(plan.n_labels, F.col("label").cast("int"))
           .sortWithinPartitions("label", "lent", F.col("id").desc_nulls_last(), F.col("h").desc()))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
        edited = _edited(text, following)
        changed = winnow(edited, k, w)
        return len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, changed, likeness(mine[0], changed[0]), likeness(mine[0], theirs[0])

    def batch(out: list, id_type: pa.DataType) -> pa.RecordBatch:
        ids, chars, digests, mine, changed, near_edited, near_next = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(chars, pa.int64()), pa.array(digests, pa.string()), _marks(mine), _marks(changed),
                                           pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, marks, held = [], 0, None
        for b in batches:
            id_type = b.column(0).type
            for at in range(b.num_rows):
                doc_id, text, h, label, is_lent = (b.column(c)[at].as_py() for c in range(5))
                if held and held["label"] == label and not is_lent and (h, doc_id) == (held["h"], held["id"]):
                    held["copies"] += 1
                    continue
                mine = winnow(text, k, w)
                if held and held["label"] == label:
                    row = (held["id"], *compared(held["text"], held["marks"], text, mine))
                    for _ in range(held["copies"]):
                        out.append(row)
                        marks += len(row[3][0]) + len(row[4][0])
                        if len(out) >= 1000 or marks > OUT_MARKS:
                            yield batch(out, id_type)
                            out, marks = [], 0
                held = {"label": label, "h": h, "id": doc_id, "copies": 1, "text": text, "marks": mine}
        if out:
            yield batch(out, id_type)

    return small_batches(met.select("id", "text", "h", "label", "lent")).mapInArrow(
        run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint {_SQL_MARKS}, edited_fingerprint {_SQL_MARKS}, near_edited double, near_next double")
