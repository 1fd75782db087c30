"""Greedy leader set over an ordered graph.

Walking items in order and keeping an item unless an already kept item is
adjacent yields the lexicographically first maximal independent set. It is
computed in parallel rounds (Blelloch, Fineman and Shun, 2012): an undecided
node with no undecided earlier neighbour is kept; undecided later neighbours
of kept nodes are removed; repeat. Every round writes its small state to the
session's checkpoint folder, so a lost executor costs at most one round and
later rounds never recompute earlier ones. Once at most ``WALK_EDGES`` edges
are left, one task walks them in order, so long chains need few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.joins import shuffled
from docsift.session import ensure_checkpoint_dir, write_table

#: Edges that one task may walk (a bounded rest, some megabytes).
WALK_EDGES = 200_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    earlier: dict[int, list[int]] = {}
    nodes: set[int] = set()
    for b in batches:
        for src, dst in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            earlier.setdefault(dst, []).append(src)
            nodes.update((src, dst))
    leader: dict[int, int] = {}
    order = sorted(nodes)
    for n in order:
        leader[n] = min((p for p in earlier.get(n, ()) if leader[p] == p), default=n)
    yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array([leader[n] for n in order], pa.int64())],
                                     names=["id", "leader"])


def greedy(edges: DataFrame) -> DataFrame:
    """``id, leader`` for every node that has an edge: a kept node leads itself,
    any other belongs to its earliest adjacent kept node.

    ``edges(src, dst)`` must be distinct, cheap to read again (a written table)
    and satisfy src < dst in the walk order (ids are the order). Nodes without
    edges are kept and not listed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    every = e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    kept_parts: list[DataFrame] = []
    while e.count() > WALK_EDGES:
        nodes = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
        kept = write_table(nodes.join(shuffled(e.select(F.col("dst").alias("id"))), "id", "left_anti"), "greedy-kept")
        removed = e.join(shuffled(kept.withColumnRenamed("id", "src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        gone = write_table(kept.union(removed), "greedy-gone")
        e = write_table(e.join(shuffled(gone.withColumnRenamed("id", "src")), "src", "left_anti")
                        .join(shuffled(gone.withColumnRenamed("id", "dst")), "dst", "left_anti"), "greedy-edges")
        # a node whose edges all went with this round is free, and so kept
        left = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
        free = nodes.join(shuffled(gone), "id", "left_anti").join(shuffled(left), "id", "left_anti")
        kept_parts.append(write_table(kept.union(free), "greedy-kept"))
    walked = e.repartition(1).mapInArrow(_walk, "id long, leader long")
    if not kept_parts:
        return walked
    kept = walked.filter("id = leader").select("id")
    for p in kept_parts:
        kept = kept.union(p)
    kept = write_table(kept, "greedy-kept")
    owned = every.join(shuffled(kept.withColumnRenamed("id", "src")), "src", "left_semi").join(shuffled(kept.withColumnRenamed("id", "dst")), "dst", "left_anti")
    return kept.select("id", F.col("id").alias("leader")).union(owned.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("leader")))
