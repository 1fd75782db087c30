"""Exact deduplication by Grace hashing.

1. Every input task runs its rows through an open-addressing table that
   compares complete normalised contents, and spills one record per distinct
   content (with count and best row) to the shared folder. A group of copies,
   however large, leaves one record per task, so no later task meets it whole.
2. Buckets are prefixes of the content's hash. Their sizes (distinct bytes)
   are measured; a bucket beyond ``bucket_bytes`` is partitioned again by the
   next bits, recursively, until each fits or holds a single hash.
3. The spilled records go to their buckets (the exchange's files are the
   partition files), and each bucket is merged in one open-addressing table.

A table never holds more than ``bucket_bytes`` of distinct contents, or one
content if that is larger. Nothing but bucket sizes reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import WS_CHARS, content_key, materialize, one_row_each, small_batches

BUCKET_BYTES = 32 << 20
#: Bits of the hash that each level of partitioning takes.
FAN_BITS = 4
#: Rows and bytes in an Arrow batch that a task returns.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20

_DELETE = WS_CHARS.encode()


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the complete
    contents are equal, the hash alone never decides."""

    def __init__(self, capacity: int = 1024):
        self.mask = capacity - 1
        self.slots = [-1] * capacity
        self.entries: list[list] = []  # [hash, content, digest, copies, best row, rows equal to it]
        self.n_bytes = 0

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for i, e in enumerate(self.entries):
            at = e[0] & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def add(self, h: int, content: bytes, copies: int, row: tuple, alike: int, digest: str | None = None) -> str:
        """Count ``copies`` of ``content``; its digest. The best row is the least
        of (-code points, id is null, id, key); ``alike`` rows are equal to ``row``."""
        at = h & self.mask
        while (i := self.slots[at]) >= 0:
            e = self.entries[i]
            if e[0] == h and e[1] == content:
                e[3] += copies
                if row < e[4]:
                    e[4], e[5] = row, alike
                elif row == e[4]:
                    e[5] += alike
                return e[2]
            at = (at + 1) & self.mask
        self.slots[at] = len(self.entries)
        digest = digest or hashlib.sha256(content).hexdigest()
        self.entries.append([h, content, digest, copies, row, alike])
        self.n_bytes += len(content) + 200
        if 3 * len(self.entries) > 2 * self.mask:
            self._grow()
        return digest

    def columns(self, part: list, id_type: pa.DataType) -> list[pa.Array]:
        """digest, id, points, key, alike, copies of the entries ``part``."""
        rows = [e[4] for e in part]
        return [pa.array([e[2] for e in part], pa.string()), pa.array([None if none else x for _, none, x, _ in rows], id_type),
                pa.array([-p for p, *_ in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
                pa.array([e[5] for e in part], pa.int64()), pa.array([e[3] for e in part], pa.int64())]


#: Columns of a distinct content's best row and counts.
_BEST = "digest string, doc_id {id}, points bigint, key bigint, alike bigint, copies bigint"


def _row(points: int, key, content_key: int, zero) -> tuple:
    return (-points, key is None, zero if key is None else key, content_key)


def _spill(batches: Iterator[pa.RecordBatch], bucket_bytes: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, text, key) -> member rows (digest, id) and, content not null, records."""
    names = ["digest", "doc_id", "points", "key", "alike", "copies", "h", "content"]
    zero = pa.scalar(0).cast(id_type).as_py()
    table = ContentTable()

    def records(t: ContentTable) -> Iterator[pa.RecordBatch]:
        for part in sliced(t.entries, lambda e: len(e[1])):
            h = np.array([e[0] for e in part], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*t.columns(part, id_type), pa.array(h), pa.array([e[1] for e in part], pa.binary())], names=names)

    for batch in batches:
        ids, digests = batch.column(0).to_pylist(), []
        for doc_id, text, key in zip(ids, batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py() or ""
            content = text.encode().translate(None, _DELETE)
            digests.append(table.add(xxhash.xxh64_intdigest(content), content, 1, _row(len(text), doc_id, key, zero), 1))
            if table.n_bytes > bucket_bytes:
                yield from records(table)
                table = ContentTable()
        none = pa.nulls(len(ids), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), batch.column(0).cast(id_type), none, none, none, none, none,
                                          pa.nulls(len(ids), pa.binary())], names=names)
    yield from records(table)


def sliced(items: list, n_bytes) -> Iterator[list]:
    """Consecutive parts of bounded rows and bytes."""
    part, total = [], 0
    for x in items:
        part.append(x)
        total += n_bytes(x)
        if len(part) >= OUT_ROWS or total >= OUT_BYTES:
            yield part
            part, total = [], 0
    if part:
        yield part


def _merge(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Records sorted by bucket -> one row for each distinct content."""
    zero = pa.scalar(0).cast(id_type).as_py()

    def classes(t: ContentTable) -> Iterator[pa.RecordBatch]:
        for part in sliced(t.entries, lambda e: 100):
            yield pa.RecordBatch.from_arrays(t.columns(part, id_type), names=["digest", "doc_id", "points", "key", "alike", "copies"])

    table, bucket = ContentTable(), None
    for batch in batches:
        c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        h = c["h"].to_numpy().view(np.uint64).tolist()
        rows = zip(*(c[n].to_pylist() for n in ("bucket", "copies", "points", "doc_id", "key", "alike", "digest")), h, c["content"])
        for b, copies, points, doc_id, key, alike, digest, h, content in rows:
            if b != bucket:
                yield from classes(table)
                table, bucket = ContentTable(), b
            table.add(h, content.as_py(), copies, _row(points, doc_id, key, zero), alike, digest)
    yield from classes(table)


def bucket_column(records: DataFrame, bucket_bytes: int) -> Column:
    """The bucket of a record: a prefix of ``h``, longer where the shorter one's
    distinct contents exceed ``bucket_bytes``. The driver gets the oversized
    prefixes of each level alone, at most total bytes / ``bucket_bytes``."""
    distinct = records.groupBy("h").agg(F.max(F.length("content") + 200).alias("b"))
    total = distinct.agg(F.sum("b")).first()[0] or 0
    bits = 0
    while bits < 48 and (total >> bits) > bucket_bytes // 2:
        bits += FAN_BITS

    def prefix(n: int) -> Column:
        p = F.shiftrightunsigned("h", 64 - n) if n else F.lit(0).cast("long")
        return F.concat_ws(":", F.lit(str(n)), p.cast("string"))

    bucket, pending = prefix(bits), F.lit(True)
    while bits + FAN_BITS < 64:
        sizes = distinct.filter(pending).groupBy(prefix(bits).alias("p")).agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
        over = [r.p for r in sizes.filter((F.col("b") > bucket_bytes) & (F.col("n") > 1)).select("p").collect()]
        if not over:
            break
        pending = prefix(bits).isin(over)
        bits += FAN_BITS
        bucket = F.when(pending, prefix(bits)).otherwise(bucket)
    return bucket


def _grouped(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(members: digest, doc_id of every row; classes: digest, doc_id, points,
    key, alike, copies of every distinct content)."""
    name = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(name)
    if id_type is None:
        raise TypeError(f"{id_col}: a bigint, int or string id is needed, not {name}")

    def spill(batches):
        return _spill(batches, bucket_bytes, id_type)

    def merge(batches):
        return _merge(batches, id_type)

    best = _BEST.format(id=name)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), content_key(id_col, text_col).alias("key"))
    spilled = materialize(small_batches(rows).mapInArrow(spill, f"{best}, h bigint, content binary"), "grace-spill")
    records = spilled.filter(F.col("content").isNotNull())
    classes = (records.withColumn("bucket", bucket_column(records, bucket_bytes)).repartition("bucket").sortWithinPartitions("bucket")
               .mapInArrow(merge, best))
    return spilled.filter(F.col("content").isNull()).select("digest", "doc_id"), materialize(classes, "grace-classes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Group rows whose texts are equal without white space; one row per input row.

    Returns ``doc_id`` (the type of ``id_col``), ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256`` (of the normalised text). Of equal texts the
    row with the most code points stays, then the smallest id, null ids last.
    Repeated rows (same id, same text) form one group: each is listed, with
    the same verdict, and ``kept`` is true for them if their id is kept (see
    :func:`drop_copies` for a table with one row left). Null texts count as
    empty, empty and all-white-space texts are equal to one another. Other
    columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    members, classes = _grouped(docs, id_col, text_col, bucket_bytes)
    of_class = classes.select("digest", F.col("doc_id").alias("keep_id"), F.col("copies").alias("group_size"))
    return members.join(of_class, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (all columns) with one row left of each group of equal texts: the
    row that :func:`exact_groups` keeps; of repeated rows one."""
    _, classes = _grouped(docs, id_col, text_col, bucket_bytes)
    return one_row_each(docs, classes.select(F.col("doc_id").alias("id"), "key", F.col("alike").alias("n")), id_col, text_col)
