"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of a
fixed length. Output slots are dealt in shards; each slot of a shard draws its
source from the target shares, so a shard's counts are multinomial. Draws beyond
a source's quota are handed to the sources that the draws left short, so that
every source gets its quota exactly. A source's n-th slot is mapped to a block
by a pseudorandom permutation of the block numbers, a new one for each pass
over the source, so no block is used a second time before every block was used
once, and none a third time. Blocks are then joined by number.

Only DataFrame functions are used. Sums over documents run in two steps (within
hash ranges, then over the ranges), so no source meets in one task; repeated
rows are counted before they are placed. Draws and permutations are hashes of
the seed, ids and numbers: reruns agree, however the table is partitioned.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import WS_CLASS, content_key, let, materialize, text_of

WEIGHTS = (3.0, 1.0, 2.0)
#: Words in the mix to words in the table; times that a source may be used.
TOTAL, MOST = 1.5, 2.0
#: Words in a block, slots in a shard.
BLOCK_WORDS, SHARD_SLOTS = 64, 4096
#: Buckets of the unit interval.
BUCKETS = 4096
ROUNDS, WALK = 4, 40
SEED = 20240607


class Mix(NamedTuple):
    """``documents``: doc_id, source, size, source_size, target, taken, one row
    per input row. ``slots``: shard, slot, source, block. ``parts``: doc_id, key,
    copies, copy, size, first, length, uses: the parts of documents in blocks that
    the mix uses (words from ``first``), ``key`` as of ``content_key``."""

    documents: DataFrame
    slots: DataFrame
    parts: DataFrame


def targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``sid`` (1.. by code point, null
    last), ``weight`` and ``target``: shares by weight of ``total`` times all
    sizes, no target above ``most`` times its size, the excess reshared.

    In the order of cap / weight a source is capped if the share that is left
    for it and those after it would be above its cap. The windows run over the
    table of sources, not of documents.
    """
    cycle = F.array(*map(F.lit, weights))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("sid") - 1) % len(weights))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = total * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("share", share).withColumn("capped", F.col("share") * F.col("weight") > F.col("cap"))
    # the share of the first source that isn't capped holds for all after it
    rate = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("share")))).over(every)["share"]
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(rate, F.lit(0.0)) * F.col("weight"))).select(
        "source", "source_size", "sid", "weight", "target")


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The place of ``i`` under a pseudorandom permutation of 0 .. n-1.

    A Feistel network over pairs (l, r) with l < a, r < b, where a * b is the
    next such product from n on; a number beyond n is mapped again until it is
    below n. At most a of a * b numbers are beyond, so ``WALK`` steps do.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def rounds(x: Column, a: Column, b: Column) -> Column:
        l, r = F.floor(x / b).cast("long"), F.pmod(x, b)
        pair = F.struct(l.alias("l"), r.alias("r"))

        def turn(p: Column, k: Column) -> Column:
            left = F.struct(F.pmod(p["l"] + F.pmod(F.xxhash64(*key, k, p["r"]), a), a).alias("l"), p["r"].alias("r"))
            right = F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(*key, k, p["l"]), b), b).alias("r"))
            return F.when(k % 2 == 0, left).otherwise(right)

        done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turn)
        return let(done, lambda p: p["l"] * b + p["r"])

    def walk(ab: Column) -> Column:
        a, b = ab["a"], ab["b"]
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), rounds(i, a, b), lambda x, _: F.when(x < n, x).otherwise(rounds(x, a, b)))
        return let(end, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("permutation: no number in range")).cast("long")))

    return let(F.struct(a.alias("a"), F.ceil(n / a).cast("long").alias("b")), walk)


def in_interval(points: DataFrame, at: str, width: float, intervals: DataFrame) -> DataFrame:
    """Join each point to the interval [lo, hi) that holds it, by an equality on
    ``floor(at / width)``; an interval has one row for each bucket it meets."""
    spread = intervals.filter("lo < hi").withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("lo") / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))))
    return (points.withColumn("_b", F.floor(F.col(at) / width).cast("long")).join(spread, "_b")
            .filter((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_b", "lo", "hi"))


def running(column: str, order: Window) -> Column:
    """The sum of ``column`` over the rows before this one."""
    return F.coalesce(F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _placed(units: DataFrame, n_rows: int) -> DataFrame:
    """``units`` with ``start``: the first word's number in its source's stream.

    There are about as many hash ranges as the root of the number of rows, so
    neither a range nor the ranges of a source are many rows."""
    bits = (math.isqrt(n_rows)).bit_length()
    units = units.withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = units.groupBy("sid", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    base = materialize(sums.select("sid", "range", running("words", Window.partitionBy("sid").orderBy("range")).alias("base")), "mix-ranges")
    units = units.withColumn("words", F.col("size") * F.col("copies"))
    order = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size")
    return units.withColumn("inner", running("words", order)).join(base, ["sid", "range"]).withColumn("start", F.col("base") + F.col("inner")).drop(
        "range", "words", "inner", "base")


def _slots(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, sid, nth: every slot's source and its number among that
    source's slots, 0 .. quota-1."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("quota")).first()[0] or 0
    edges = plan.select("sid", "quota", (running("quota", Window.orderBy("sid")) / total).alias("lo"),
                        (F.sum("quota").over(Window.orderBy("sid")) / total).alias("hi")) if total else \
        plan.select("sid", "quota", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    drawn = spark.range(total).select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), F.col("id").alias("slot"),
                                      uniform(F.lit(seed), F.lit("draw"), F.col("id")).alias("u"))
    drawn = materialize(in_interval(drawn, "u", 1.0 / BUCKETS, edges).select("shard", "slot", "sid", "quota"), "mix-draws")
    counts = drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n"), F.first("quota").alias("quota"))
    before = materialize(counts.select("sid", "shard", "n", "quota", running("n", Window.partitionBy("sid").orderBy("shard")).alias("before")), "mix-counts")
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    numbered = materialize(drawn.withColumn("r", nth).join(before.select("sid", "shard", "before"), ["sid", "shard"])
                           .select("shard", "slot", "sid", "quota", (F.col("before") + F.col("r")).alias("nth")), "mix-numbered")
    settled = numbered.filter("nth < quota")
    # slots whose draw was beyond the quota, in slot order, to the sources that lack slots
    beyond = numbered.filter("nth >= quota")
    per_shard = beyond.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    shard_base = per_shard.select("shard", running("n", Window.orderBy("shard")).alias("base"))
    spare = beyond.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1).join(shard_base, "shard").select(
        "shard", "slot", (F.col("base") + F.col("r")).alias("at"))
    got = settled.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    short = plan.join(got, "sid", "left").select("sid", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("lack"))
    by_sid = Window.orderBy("sid")
    lacks = short.select("sid", "got", running("lack", by_sid).alias("lo"), F.sum("lack").over(by_sid).alias("hi"), running("lack", by_sid).alias("first"))
    filled = in_interval(spare, "at", 256.0, lacks).select("shard", "slot", "sid", (F.col("got") + F.col("at") - F.col("first")).alias("nth"))
    return settled.select("shard", "slot", "sid", "nth").union(filled)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> Mix:
    """Mix the words of ``docs`` (see :class:`Mix` for what comes back).

    A null text has no words; a null source is a source of its own, the last in
    order; null ids are passed on. A document without words takes none. Repeated
    rows stand in the stream once each. Other columns are ignored. An empty
    table, or one without words, gives no slots and targets of zero.
    """
    units = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), content_key(id_col, text_col).alias("key"),
                    F.regexp_count(text_of(text_col), F.lit(f"[^{WS_CLASS}]+")).cast("long").alias("size"))
        .groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-units")
    n_rows = units.count()
    plan = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, total, most)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    plan = plan.withColumn("blocks", blocks).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), F.floor(blocks * most).cast("long")))
        .otherwise(F.lit(0).cast("long")))
    plan = materialize(plan, "mix-plan")
    of_source = plan.select(F.col("source").alias("_s"), "sid", "source_size", "target")
    units = materialize(_placed(units.join(of_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), n_rows), "mix-placed")
    slots = _slots(plan.select("sid", "quota"), shard_slots, seed).join(plan.select("sid", "source", "blocks"), "sid")
    turn = F.floor(F.col("nth") / F.col("blocks")).cast("long")
    slots = materialize(slots.withColumn("block", permuted(F.pmod("nth", "blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), turn))
                        .select("shard", "slot", "sid", "source", "block"), "mix-slots")
    uses = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    copies = units.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn(
        "start", F.col("start") + F.col("copy") * F.col("size"))
    copies = copies.select("doc_id", "key", "source", "sid", "source_size", "target", "size", "copies", "copy", "start")
    pieces = copies.filter("size > 0").select("doc_id", "key", "sid", "size", "copies", "copy", "start", F.explode(F.sequence(
        F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long"))).alias("block"))
    low, high = F.greatest(F.col("block") * block_words, F.col("start")), F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    parts = materialize(pieces.join(uses, ["sid", "block"]).select("doc_id", "key", "copies", "copy", "size", "sid", "start",
                                                                  (low - F.col("start")).alias("first"), (high - low).alias("length"), "uses"), "mix-parts")
    taken = parts.groupBy("sid", "start").agg(F.sum(F.col("length") * F.col("uses")).alias("taken"))
    keyed = copies.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    documents = keyed.join(taken.withColumnRenamed("start", "at"), ["sid", "at"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return Mix(documents, slots.drop("sid"), parts.drop("sid", "start"))


def mixed_texts(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) as the mix takes them: each row's text is cut to the
    words in blocks that are used, and a row comes twice where blocks are used
    twice. Words keep the white space before them, but the first. Rows without
    a used block are left out. What a row takes of its text is bounded by it."""
    names = ["doc_id", "key", "copies", "copy"]
    ranges = mixed.parts.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("first", "length", "uses"))).alias("__ranges"))
    turns = ranges.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("__ranges", lambda r: r["uses"])))))
    turns = turns.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("copies").alias("__copies"),
                         F.filter("__ranges", lambda r: r["uses"] >= F.col("__turn")).alias("__ranges"))
    turns = materialize(turns, "mix-turns")
    keyed = docs.withColumn("__key", content_key(id_col, text_col))
    same = (F.col("__key") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__id"))
    joined = keyed.join(turns.filter("__copies = 1"), same)
    if not turns.filter("__copies > 1").isEmpty():
        several = turns.filter("__copies > 1")
        once = keyed.join(several, same, "left_semi").dropDuplicates([id_col, "__key"])
        joined = joined.unionByName(once.join(several, same))
    pieces = F.regexp_extract_all(text_of(text_col), F.lit(f"[{WS_CLASS}]*[^{WS_CLASS}]+"), F.lit(0))
    cut = let(pieces, lambda p: F.concat_ws("", F.flatten(F.transform("__ranges", lambda r: F.slice(p, (r["first"] + 1).cast("int"), r["length"].cast("int"))))))
    out = joined.withColumn(text_col, F.regexp_replace(cut, f"^[{WS_CLASS}]+", ""))
    return out.select(*docs.columns)
