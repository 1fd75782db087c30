"""A stored index of perceptual hashes, read in proportion to what is looked up.

Every stored hash has one row for each combination of blocks that near hashes
may agree on (see ``hamming``), written once, when the hash is stored. The rows
lie in shards by a hash of (combination, key), about ``shard_rows`` each, so a
batch of b hashes opens at most b shards for each combination, however many
hashes are stored; its own keys are the only ones that are worked out again.

A folder holds generations, ``gen-<number>-<shards>``: ``base`` and, beside it,
the rows of later batches by batch id. :meth:`HashIndex.compact` merges all but
the last batch into the base of a new generation with as many shards as the rows
need. A generation counts once its base is committed, so a compaction that dies
leaves the one before in use; a batch that is written again replaces its own
rows alone, and compaction never moves the one batch that a stream may repeat.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators.hamming import AGREE, key_rows

#: Rows of a shard that compaction aims at, and most shards.
SHARD_ROWS, MOST_SHARDS = 1 << 20, 1 << 16
#: Batches beside the base after which :meth:`HashIndex.append` compacts.
MOST_BATCHES = 16

_ROWS = "combo bigint, key bigint, hash bigint, batch_id bigint, shard int"


class HashIndex:
    """The index in folder ``path`` for near hashes at ``threshold``; a folder that
    isn't there is an empty index. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, threshold: int = C.DEFAULT_THRESHOLD, agree: int = AGREE,
                 shard_rows: int = SHARD_ROWS, most_batches: int = MOST_BATCHES):
        self.spark, self.path, self.threshold, self.agree = spark, path.rstrip("/"), threshold, agree
        self.shard_rows, self.most_batches = shard_rows, most_batches

    # folders

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        fs = self._fs()
        return sorted(f.getPath().getName() for f in fs.listStatus(self._path(path))) if fs.exists(self._path(path)) else []

    def generation(self) -> tuple[int, int] | None:
        """(number, shards) of the latest committed generation."""
        found = [tuple(map(int, m.groups())) for m in (re.fullmatch(r"gen-(\d+)-(\d+)", n) for n in self._names(self.path)) if m]
        return max((g for g in found if self._fs().exists(self._path(f"{self._folder(*g)}/base/_SUCCESS"))), default=None)

    def _folder(self, number: int, shards: int) -> str:
        return f"{self.path}/gen-{number}-{shards}"

    def _batches(self, g: tuple[int, int]) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names(f"{self._folder(*g)}/batches") if n.startswith("batch_id="))

    # rows

    @staticmethod
    def _shard(shards: int) -> Column:
        return F.pmod(F.xxhash64("combo", "key"), F.lit(shards)).cast("int")

    def _keyed(self, hashes: DataFrame, shards: int) -> DataFrame:
        return key_rows(hashes, "hash", self.threshold, self.agree).withColumn("shard", self._shard(shards))

    def rows(self, g: tuple[int, int] | None = None) -> DataFrame:
        """All rows of a generation (default: the latest)."""
        g = g or self.generation()
        if g is None:
            return self.spark.createDataFrame([], _ROWS)
        base = self.spark.read.schema(_ROWS).parquet(f"{self._folder(*g)}/base")
        if not self._batches(g):
            return base
        later = self.spark.read.schema(_ROWS).parquet(f"{self._folder(*g)}/batches")
        return base.unionByName(later)

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        """A shard's rows in one task and one sorted file."""
        rows.repartition("shard").sortWithinPartitions("shard", "combo", "key").write.mode("overwrite").partitionBy("shard").parquet(path)

    def append(self, hashes: DataFrame, batch_id: int) -> None:
        """Store the ``hash`` column of new hashes under ``batch_id``; again with the
        same id, the rows are replaced."""
        g = self.generation()
        if g is None:
            g = (0, 1)
            self._write(self.rows(), f"{self._folder(*g)}/base")
        self._write(self._keyed(hashes.select("hash"), g[1]), f"{self._folder(*g)}/batches/batch_id={batch_id}")
        if len(self._batches(g)) > self.most_batches:
            self.compact()

    def compact(self) -> None:
        """Merge the base and all batches but the last into a new generation."""
        g = self.generation()
        if g is None:
            return
        batches = self._batches(g)
        rows = self.rows(g)
        shards = min(MOST_SHARDS, max(1, -(-rows.count() // self.shard_rows)))
        new = (g[0] + 1, shards)
        fs = self._fs()
        for name in self._names(self.path):
            if name != f"gen-{g[0]}-{g[1]}":  # older than what is in use, or of a compaction that died
                fs.delete(self._path(f"{self.path}/{name}"), True)
        placed = rows.withColumn("shard", self._shard(shards))
        if batches:
            last = F.col("batch_id") == batches[-1]
            self._write(placed.filter(last).drop("batch_id"), f"{self._folder(*new)}/batches/batch_id={batches[-1]}")
            placed = placed.filter(~last)
        self._write(placed, f"{self._folder(*new)}/base")

    # look-ups

    def _opened(self, keyed: DataFrame, g: tuple[int, int]) -> DataFrame:
        """Rows of the shards that ``keyed`` falls in. The driver gets their numbers, at
        most MOST_SHARDS."""
        rows = self.rows(g)
        if g[1] == 1:
            return rows
        touched = [r.shard for r in keyed.select("shard").distinct().collect()]
        return rows if len(touched) == g[1] else rows.filter(F.col("shard").isin(touched))

    def opened_rows(self, hashes: DataFrame) -> int:
        """How many index rows a look-up of ``hashes`` reads."""
        g = self.generation()
        return 0 if g is None else self._opened(self._keyed(hashes, g[1]), g).count()

    def near(self, nodes: DataFrame, but_batch: int | None = None) -> DataFrame:
        """``node`` of the rows (node, hash) of ``nodes`` that are near a stored hash;
        hashes stored under ``but_batch`` don't count. ``nodes`` must be cheap to read
        again (a written table)."""
        g = self.generation()
        if g is None:
            return nodes.select("node").limit(0)
        keyed = self._keyed(nodes.select("node", "hash"), g[1])
        stored = self._opened(keyed, g)
        if but_batch is not None:
            stored = stored.filter(F.col("batch_id") != but_batch)
        a, b = keyed.alias("a"), stored.alias("b")
        near = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash"))) <= self.threshold
        same = (F.col("a.combo") == F.col("b.combo")) & (F.col("a.key") == F.col("b.key"))
        return a.join(b, same & near, "left_semi").select("node").distinct()
