"""Hamming-distance join of 64-bit hashes without comparing all pairs.

Pigeonhole over block combinations: cut the 64 bits into ``b`` blocks. Two
hashes within distance ``t`` differ in at most ``t`` blocks, so they agree on
at least ``r = b - t`` of them. Every combination of ``r`` blocks is a key of
about ``64 * r / b`` bits, and the theta join ``bit_count(a ^ b) <= t`` becomes
an equi-join on (combination, the hash masked to it) with an exact check. With
``t = 5`` and the default of three agreeing blocks that is 56 keys of 24 bits:
unrelated hashes meet about n^2 / 600,000 times, against n^2 / 512 with one
band of ten bits. A larger ``agree`` gives more and longer keys.

A pair that agrees on several combinations is emitted only for the first, so
no ``distinct`` (and no extra shuffle) follows. Exact copies must be collapsed
before (``dedup.collapse_exact``). A hot key is split by AQE's skew join.

The keys are joined by shuffles, never by broadcast: Spark takes them for no larger
than the hashes they are made from, and would send them through the driver. A
join of many hashes takes the combinations in several passes, so that a task
sorts the keys of one pass at a time.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators.joins import shuffled

#: Blocks that near hashes must agree on.
AGREE = 3
#: Key rows of one side that a pass aims at; a pass has at least one combination.
PASS_KEYS = 1 << 23


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def blocks(threshold: int, agree: int = AGREE, bits: int = C.HASH_BITS) -> list[int]:
    """Bit masks of ``threshold + agree`` blocks that cover ``bits`` bits."""
    n = threshold + agree
    if threshold < 0 or agree < 1 or n > bits:
        raise ValueError("threshold + agreeing blocks must be between 1 and the number of hash bits")
    base, extra = divmod(bits, n)
    out, off = [], 0
    for i in range(n):
        w = base + (1 if i < extra else 0)
        out.append(((1 << w) - 1) << off)
        off += w
    return out


def passes(n: int | None, threshold: int, agree: int = AGREE) -> list[list[tuple[int, ...]]]:
    """The block combinations for a join of (at most) ``n`` hashes a side, by pass."""
    every = list(combinations(range(threshold + agree), agree))
    size = len(every) if n is None else max(1, PASS_KEYS // max(1, n))
    return [every[i:i + size] for i in range(0, len(every), size)]


def key_rows(df: DataFrame, hash_col: str, threshold: int, agree: int = AGREE, combos: list[tuple[int, ...]] | None = None) -> DataFrame:
    """One row per (input row, combination): ``combo`` (block set), ``key`` (masked hash)."""
    masks = blocks(threshold, agree)
    keys = []
    for chosen in combos or combinations(range(len(masks)), agree):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.struct(F.lit(sum(1 << i for i in chosen)).cast("long").alias("combo"),
                             F.col(hash_col).bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("key")))
    return df.select("*", F.inline(F.array(*keys)))


def first_combination(x: Column, threshold: int, agree: int = AGREE) -> Column:
    """The first ``agree`` blocks (as a block set) in which the XOR ``x`` of two hashes is zero."""
    equal = F.lit(0).cast("long")
    for i, mask in enumerate(blocks(threshold, agree)):
        same = x.bitwiseAND(F.lit(_signed(mask)).cast("long")) == 0
        equal = equal + F.when(same, F.lit(1 << i)).otherwise(F.lit(0))
    chosen, rest = F.lit(0).cast("long"), equal
    for _ in range(agree):
        low = rest.bitwiseAND(-rest)
        chosen, rest = chosen + low, rest - low
    return chosen


def candidates(left: DataFrame, right: DataFrame | None = None, threshold: int = C.DEFAULT_THRESHOLD,
               id_col: str = "ord", hash_col: str = "hash", agree: int = AGREE, n: int | None = None) -> DataFrame:
    """The joined rows ``id_a, h_a, id_b, h_b, combo`` before the exact check."""
    found = None
    for combos in passes(n, threshold, agree):
        lrows = key_rows(left.select(id_col, hash_col), hash_col, threshold, agree, combos)
        rrows = lrows if right is None else key_rows(right.select(id_col, hash_col), hash_col, threshold, agree, combos)
        a = lrows.select(F.col(id_col).alias("id_a"), F.col(hash_col).alias("h_a"), "combo", "key")
        b = rrows.select(F.col(id_col).alias("id_b"), F.col(hash_col).alias("h_b"), "combo", "key")
        j = a.join(shuffled(b), ["combo", "key"])
        found = j if found is None else found.unionByName(j)
    return found.filter(F.col("id_a") < F.col("id_b")) if right is None else found


def near_pairs(left: DataFrame, right: DataFrame | None = None, threshold: int = C.DEFAULT_THRESHOLD,
               id_col: str = "ord", hash_col: str = "hash", agree: int = AGREE, n: int | None = None) -> DataFrame:
    """Pairs ``(id_a, id_b, distance)`` with ``distance <= threshold``.

    Without ``right`` it is a self-join and each unordered pair appears once
    with ``id_a < id_b``. Rows must have distinct hashes within each side. With
    ``n``, the (most) hashes of a side, a join of many takes several passes; the
    sides must then be cheap to read again (written tables).
    """
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    return (candidates(left, right, threshold, id_col, hash_col, agree, n).withColumn("distance", F.bit_count(x))
            .filter((F.col("distance") <= threshold) & (first_combination(x, threshold, agree) == F.col("combo")))
            .select("id_a", "id_b", "distance"))
