"""Quality rules with adaptive thresholds.

Each document's signals are counted on its whole text. For every language and
source a quantile sketch of each ratio is kept: counts in logarithmic buckets
of relative width ``ACCURACY``, at most a few thousand however many documents
there are. Sketches of the same ratio merge by adding counts, which is how the
tasks' parts, and the sketches of a language and of the whole table (for groups
with few documents), come about. Thresholds are read from the sketches and
joined to the documents.

Only DataFrame functions are used. Merging is exact and independent of order,
so the verdicts are the same on every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import WS_CLASS, let, materialize, text_of, words

SYMBOLS = "#*$%&|<>"
#: Base rules: least words; most per cent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Relative accuracy of a sketch's quantiles; ratios below SMALLEST count as zero.
ACCURACY, SMALLEST = 0.01, 1e-6
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: A group with fewer documents takes its language's thresholds, or the table's.
MIN_GROUP = 100
#: A fence lies FENCE times the distance from the median to the tail quantile beyond that
#: quantile; BLUR is what the sketch may take off that distance, as a share of the quantile.
FENCE, BLUR = 3.0, 2 * ACCURACY
TAILS = (0.1, 0.5, 0.9)
#: ratio -> (least distance of its fences: one occurrence in the shortest text that the
#: base rules pass; the count and how much of it one occurrence makes, which is never
#: beyond a fence; has a lower fence too).
RATIOS = {
    "symbol_ratio": (1 / MIN_WORDS, "n_symbols", 1, False),
    "dup_line_ratio": (1 / MIN_WORDS, "n_dup_lines", 1, False),
    "repeat_ratio": (6 / MIN_WORDS, "n_repeat_words", 6, False),
    "word_length": (1 / MIN_WORDS, None, 0, True),
}


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` inside 3-word windows that occur twice or more.

    Equal windows have equal hashes, so a text whose window hashes are all
    distinct has none; any other is decided on the windows themselves.
    """
    def gram(i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def exact(_: Column) -> Column:
        ordered = F.array_sort(F.transform(starts, lambda i: F.struct(gram(i).alias("g"), i.alias("i"))))
        return let(ordered, lambda s: let(
            F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(
                (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull())),
            lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)))

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) >= 3, found).otherwise(F.lit(0)).cast("long")


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines (with a
    word), n_dup_lines, n_repeat_words; one row per input row."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WS_CLASS}]"))
    per_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        per_word.alias("w"), per_line.alias("l"),
        (F.char_length(text) - F.regexp_count(text, F.lit(f"[{WS_CLASS}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def with_base(found: DataFrame) -> DataFrame:
    """``signals`` with ``base_failed`` and the ratios (null without words)."""
    n = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return found.select(
        "*", ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbol_ratio"), (F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"), (F.col("word_chars") / n).alias("word_length"))


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: the sketch of each ratio over the rows
    that pass the base rules (bucket null: zero)."""
    ratios = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in RATIOS])).alias("x")
    bucket = F.when(F.col("x.v") >= SMALLEST, F.ceil(F.log(F.col("x.v")) / math.log(GAMMA)).cast("int"))
    return (rated.filter(~F.col("base_failed")).select("lang", "source", ratios)
            .select("lang", "source", F.col("x.ratio").alias("ratio"), bucket.alias("bucket"))
            .groupBy("lang", "source", "ratio", "bucket").agg(F.count(F.lit(1)).alias("n")))


def tails(sketch: DataFrame, *by: str) -> DataFrame:
    """Quantiles of merged sketches: one row for each group ``by``, with n and,
    for each ratio, a struct (low, mid, high)."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "ratio")
    upto = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0))
    counted = merged.select(*by, "ratio", value.alias("v"), upto.alias("upto"), F.sum("n").over(group).alias("all"))
    at = [F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))).alias(name) for q, name in zip(TAILS, ("low", "mid", "high"))]
    each = counted.groupBy(*by, "ratio").agg(F.max("all").alias("n"), *at)
    return each.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("ratio") == r, F.struct("low", "mid", "high"))).alias(r) for r in RATIOS])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and for each ratio ``<ratio>_max`` (and ``<ratio>_min``), from
    the group's own sketch, or where it has under MIN_GROUP documents from its
    language's, or the table's."""
    own, lang = tails(sketch, "lang", "source"), tails(sketch, "lang")
    table = tails(sketch.withColumn("t", F.lit(1)), "t")
    whole = table.first()  # one row of as many numbers as there are ratios
    named = lang.select(F.col("lang").alias("_l"), *[F.struct(F.col("n"), F.col(r)).alias(f"{r}_l") for r in RATIOS])
    joined = own.join(named, F.col("lang").eqNullSafe(F.col("_l")))

    def of_table(r: str) -> Column:
        values = whole[r] if whole and whole[r] else (None, None, None)
        return F.struct(*[F.lit(v).cast("double").alias(name) for v, name in zip(values, ("low", "mid", "high"))])

    out = [F.col("lang"), F.col("source")]
    for r, (least, _, _, below) in RATIOS.items():
        q = F.when(F.col("n") >= MIN_GROUP, F.col(r)).when(F.col(f"{r}_l")["n"] >= MIN_GROUP, F.col(f"{r}_l")[r]).otherwise(of_table(r))
        out.append((q["high"] + F.greatest(FENCE * (q["high"] - q["mid"] + BLUR * q["high"]), F.lit(least))).alias(f"{r}_max"))
        if below:
            out.append((q["low"] - F.greatest(FENCE * (q["mid"] - q["low"] + BLUR * q["low"]), F.lit(least))).alias(f"{r}_min"))
    return joined.select(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Signals and verdict, one row per input row: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept``: the base rules pass and every ratio lies within its group's
    fences. Null texts count as empty and fail the base rules; null languages
    and sources are groups of their own; ids are passed on, null or repeated.
    A row on a fence is within it. An empty table gives an empty table.
    """
    rated = materialize(with_base(signals(docs, id_col, text_col, lang_col, source_col)), "quality-signals")
    limits = materialize(thresholds(materialize(sketches(rated), "quality-sketches")), "quality-thresholds")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    within = F.lit(True)
    for r, (_, count, once, below) in RATIOS.items():
        inside = F.col(r) <= F.col(f"{r}_max")
        within &= inside | (F.col(count) <= once) if count else inside
        if below:
            within &= F.col(r) >= F.col(f"{r}_min")
    # a group all of whose rows fail the base rules has no thresholds, and needs none
    judged = rated.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))
