"""Near-duplicate removal over 64-bit perceptual hashes.

Rows are ``(ord, bits)``: ``ord`` is the arrival order (and the file id), and
``bits`` the 64-character hash. The plan is:

1. ``collapse_exact``: one node per distinct hash (first ``ord`` is the node
   id, the last ``ord`` is the file kept for it). This removes the hottest
   skew (many identical hashes) before any pair is formed.
2. ``assign``: nodes are taken in waves of growing size, in walk order. A
   wave's nodes are first compared with the leaders found so far, which
   removes the members of known clusters; only the rest is compared among
   itself and walked greedily. So a cluster of m near copies costs about m
   rows, not m * m / 2 pairs.
3. each other node joins its earliest adjacent leader; exact copies follow
   their node.

Groups are returned in long form (one row per member), never as collected
lists, so a very large group never has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions.hashing import bits_to_long
from docsift.operators.greedy import greedy
from docsift.operators.hamming import AGREE, near_pairs
from docsift.operators.hash_index import HashIndex
from docsift.operators.joins import shuffled
from docsift.session import write_table

#: Nodes in the first wave, and how much larger each next one is. A wave is
#: compared with itself, at most FIRST_WAVE^2 / 2 pairs where all are near.
FIRST_WAVE, WAVE_GROWTH = 512, 16
#: Wave ends up to this rank are exact; beyond it an approximate quantile does,
#: since waves need only be in order.
EXACT_RANKS = 4096
#: Up to so many hashes, near ones need agree on one block, or two: fewer and
#: shorter keys than the default three, for the same pairs.
ONE_BLOCK, TWO_BLOCKS = 1 << 15, 1 << 20


def agreeing(n: int) -> int:
    """Blocks that near hashes must agree on, for a join of ``n`` hashes."""
    return 1 if n <= ONE_BLOCK else 2 if n <= TWO_BLOCKS else AGREE


def with_hash(rows: DataFrame, bits: str = "bits") -> DataFrame:
    return rows.withColumn("hash", bits_to_long(F.col(bits)))


def collapse_exact(rows: DataFrame) -> DataFrame:
    """``node, file_ord, copies, hash, bits`` per distinct hash.

    ``node`` is the first ord with the hash (its place in the walk);
    ``file_ord`` the last one (a later file with the same hash replaces the
    earlier one, as in a dict keyed by hash).
    """
    return (with_hash(rows).groupBy("hash").agg(
        F.min("ord").alias("node"), F.max("ord").alias("file_ord"),
        F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits")))


def node_pairs(nodes: DataFrame, threshold: int = C.DEFAULT_THRESHOLD) -> DataFrame:
    """``(node_a, node_b, distance)`` with node_a < node_b and distance <= threshold."""
    nodes = write_table(nodes.select("node", "hash"), "dedup-nodes")
    n = nodes.count()
    return (near_pairs(nodes, None, threshold, "node", agree=agreeing(n), n=n)
            .select(F.col("id_a").alias("node_a"), F.col("id_b").alias("node_b"), "distance"))


def wave_ends(nodes: DataFrame, n: int | None = None) -> list[int]:
    """Node ids at which the waves of (``n``) nodes end (the last wave has no end)."""
    n = nodes.count() if n is None else n
    ranks, size = [], FIRST_WAVE
    while size < n:
        ranks.append(size)
        size *= WAVE_GROWTH
    near = [r for r in ranks if r <= EXACT_RANKS]
    ends = []
    if near:
        first = nodes.select("node").orderBy("node").limit(near[-1])
        ends = [r.e for r in first.select(F.row_number().over(_by_node()).alias("r"), F.col("node").alias("e")).filter(F.col("r").isin(near)).orderBy("e").collect()]
    far = [r / n for r in ranks if r > EXACT_RANKS]
    if far:
        ends += nodes.agg(F.percentile_approx("node", far, 100_000).alias("e")).first().e
    return ends


def _by_node():
    from pyspark.sql.window import Window

    return Window.orderBy("node")


def assign(nodes: DataFrame, threshold: int = C.DEFAULT_THRESHOLD) -> DataFrame:
    """``node, leader`` for every node (a leader leads itself). ``nodes`` must be
    cheap to read again (a written table)."""
    n = nodes.count()
    agree = agreeing(n)
    ends = wave_ends(nodes, n)
    leaders = None
    owners: list[DataFrame] = []
    for lo, hi in zip([None, *ends], [*ends, None]):
        wave = nodes.select(F.col("node").cast("long"), "hash")
        wave = wave if lo is None else wave.filter(F.col("node") > lo)
        wave = wave if hi is None else wave.filter(F.col("node") <= hi)
        if leaders is not None:
            found = near_pairs(wave, leaders.select(F.col("hash").alias("node"), "hash"), threshold, "node", agree=agree, n=n)
            of_hash = leaders.select(F.col("hash").alias("id_b"), F.col("node").alias("leader"))
            hits = write_table(found.join(shuffled(of_hash), "id_b").groupBy(F.col("id_a").alias("node")).agg(F.min("leader").alias("leader")), "dedup-hits")
            owners.append(hits)
            wave = write_table(wave.join(shuffled(hits.select("node")), "node", "left_anti"), "dedup-wave")
        pairs = write_table(near_pairs(wave, None, threshold, "node", agree=agree, n=n).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")), "dedup-pairs")
        led = wave.join(shuffled(greedy(pairs).withColumnRenamed("id", "node")), "node", "left")
        led = write_table(led.select("node", F.coalesce("leader", "node").alias("leader"), "hash"), "dedup-owners")
        owners.append(led.select("node", "leader"))
        fresh = led.filter(F.col("node") == F.col("leader")).select("node", "hash")
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
    out = owners[0]
    for o in owners[1:]:
        out = out.unionByName(o)
    return out


def dedup_plan(rows: DataFrame, threshold: int = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Every input row with ``node``, ``leader``, ``leader_file`` and ``keep``.

    A row is kept only if it is the leader's file; every other row of a group
    (exact copies included) is removed.
    """
    nodes = write_table(collapse_exact(rows), "dedup-nodes")
    owners = assign(nodes, threshold)
    lead_files = nodes.select(F.col("node").alias("leader"), F.col("file_ord").alias("leader_file"),
                              F.col("hash").alias("leader_hash"))
    per_row = with_hash(rows).join(shuffled(nodes.select("hash", "node")), "hash")
    return (per_row.join(shuffled(owners), "node").join(shuffled(lead_files), "leader")
            .withColumn("keep", F.col("ord") == F.col("leader_file")))


def leaders(rows: DataFrame, threshold: int = C.DEFAULT_THRESHOLD) -> DataFrame:
    nodes = write_table(collapse_exact(rows), "dedup-nodes")
    owners = assign(nodes, threshold)
    return owners.filter(F.col("node") == F.col("leader")).join(shuffled(nodes), "node").select(
        F.col("node").alias("ord"), "bits")


def groups(plan: DataFrame) -> DataFrame:
    """Long-form groups of more than one file: ``leader, member, group_size``."""
    sizes = plan.groupBy("leader").agg(F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > 1)
    return plan.join(shuffled(sizes), "leader").select("leader", F.col("ord").alias("member"), "group_size")


def removed(plan: DataFrame) -> DataFrame:
    """Files to delete: ``ord, leader, reason`` (exact copy or near duplicate)."""
    return plan.filter(~F.col("keep")).select(
        "ord", "leader",
        F.when(F.col("hash") == F.col("leader_hash"), F.lit("exact")).otherwise(F.lit("near")).alias("reason"))


def incremental(batch: DataFrame, store: DataFrame | HashIndex | None, threshold: int = C.DEFAULT_THRESHOLD, but_batch: int | None = None) -> DataFrame:
    """Check a batch against a stored set, then against itself in order.

    A batch row is a duplicate when a stored hash or an earlier *new* batch
    row is within the threshold; otherwise it is new and joins the store.
    Returns ``ord, status`` for every batch row.

    ``store``: rows with ``bits``, a :class:`HashIndex` (rows are read in proportion
    to the batch; what it holds under ``but_batch`` doesn't count), or None. The
    stored set is met once, before the batch meets itself.
    """
    nodes = write_table(collapse_exact(batch), "dedup-nodes")
    known = None
    if isinstance(store, HashIndex):
        known = store.near(nodes, but_batch)
    elif store is not None:
        stored = write_table(with_hash(store).select("hash").distinct(), "dedup-stored")
        n = max(nodes.count(), stored.count())
        agree = agreeing(n)
        known = near_pairs(nodes.select("node", "hash"), stored.select(F.col("hash").alias("node"), "hash"), threshold, "node", agree=agree, n=n).select(F.col("id_a").alias("node")).distinct()
    free = nodes if known is None else write_table(nodes.join(shuffled(known), "node", "left_anti"), "dedup-free")
    owners = assign(free, threshold)
    new_nodes = owners.filter(F.col("node") == F.col("leader")).select("node")
    per_row = with_hash(batch).join(shuffled(nodes.select("hash", "node")), "hash")
    is_new = per_row.join(shuffled(new_nodes.withColumn("n", F.lit(True))), "node", "left")
    return is_new.select("ord", F.when(F.coalesce("n", F.lit(False)) & (F.col("ord") == F.col("node")),
                                       F.lit("new")).otherwise(F.lit("duplicate")).alias("status"))
