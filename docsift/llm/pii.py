"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers
by their form. They are the seeds. The words around the seeds are lexical
patterns; words with a digit or an ``@`` that no base rule took, and runs of such
words, are candidate instances. Patterns and instances are a two-sided graph
that is scored in rounds: a pattern by the share of identifiers among its
distinct instances, an instance by its patterns (noisy or) and by how well its
digits suit the kind, whatever its shape. Occurrences of the instances that
score high enough are added to the base spans, which stay.

Only DataFrame functions are used. A text is read once, a whole row at a time;
everything after is keyed by row number, pattern or surface, pre-aggregated, so
that a pattern or a group of copies of any size is one row of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import WS_CLASS, let, materialize, text_of

KINDS = ("email", "ip", "card", "phone")

# The base forms, for java.util.regex. They give the matches of the plain forms
# (see the tests), but start only where a run of their characters starts or the
# match before ends, and repeat single characters only, so that long runs cost
# time in proportion and no stack.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+  of 14 to 19 digits
#   phone  \+[0-9][\x20().0-9-]+[0-9]
_LOCAL, _LABEL = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
FORMS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_LABEL}]++\.[{_LABEL}])[A-Za-z0-9.-]+?(?=\.(?![{_LABEL}])|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match (a cheap test before the regular expressions).
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words with a digit or an @.
CANDIDATE = rf"(?<![^{WS_CLASS}])[^{WS_CLASS}0-9@]*+[0-9@][^{WS_CLASS}]*+"
# Two or more words of digits and the punctuation of numbers, one space or more
# apart, that end with their words but for punctuation. Possessive, as above.
_END = rf"(?=[^{WS_CLASS}\p{{L}}0-9@]*+(?:[{WS_CLASS}]|\z))"
_NUMBER = rf"[0-9]++(?:[().+/-]++[0-9]++)*+\)?{_END}"
RUN = rf"(?<![^{WS_CLASS}])[^{WS_CLASS}\p{{L}}0-9@]*+{_NUMBER}(?:\x20++[+(]*+{_NUMBER})++"
#: Digits in a run of several words that may be one identifier: from a local phone number to the longest card.
RUN_DIGITS = (7, 19)
#: Digits of a card and of a phone number, with or without its country; groups of digits in an IP address.
CARD_DIGITS, PHONE_DIGITS, IP_GROUPS = (14, 19), (7, 15), 4

#: Characters around a span in which its context words are looked for.
CONTEXT = 64
#: Characters in a block of a text, at least CONTEXT.
BLOCK = 256
#: Rounds; least score of a pattern and of a new instance; least (soft) number of identifiers a pattern must have.
ROUNDS, PATTERN_SCORE, INSTANCE_SCORE, SUPPORT = 3, 0.6, 0.8, 3.0
#: Elements in a part of the two-step running sum.
PART = 256


def running_sums(steps: Column) -> Column:
    """array<long>: for each element the sum of those before it. In parts, so
    that the cost of appending stays in proportion to the number of elements."""
    def sums(values: Column, start: Column) -> Column:
        first = F.array(start.cast("long"))
        every = F.aggregate(values, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(every, 1, F.size(values))

    def over(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: F.slice(v, k * PART + 1, PART))
        return let(parts, lambda p: let(sums(F.transform(p, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)), F.lit(0)),
                                        lambda bases: F.flatten(F.zip_with(p, bases, sums))))

    return let(steps, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<bigint>")))


_SPAN = "array<struct<start: bigint, end: bigint, surface: string>>"


def located(text: Column, form: str) -> Column:
    """The leftmost non-overlapping matches of ``form`` in ``text``: start, end
    (code points) and surface."""
    hits, gaps = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)

    def build(h: Column, g: Column) -> Column:
        steps = F.zip_with(h, g, lambda x, y: (F.char_length(x) + F.char_length(y)).cast("long"))
        steps = F.slice(steps, 1, F.size(h))  # one more gap than matches
        return let(running_sums(steps), lambda at: F.transform(h, lambda x, i: let(
            F.get(at, i) + F.char_length(F.get(g, i)), lambda start: F.struct(
                start.alias("start"), (start + F.char_length(x)).alias("end"), x.alias("surface")))))

    found = let(hits, lambda h: F.when(F.size(h) > 0, let(gaps, lambda g: build(h, g))))
    return F.coalesce(found, F.array().cast(_SPAN))


def in_context(text: Column, spans: Column) -> Column:
    """``spans`` of ``text`` with ``before`` and ``after``: up to CONTEXT
    characters of the text on either side, whatever they are. They are cut from
    blocks of the text, so that a span doesn't cost a pass over a long text."""
    def piece(blocks: Column, start: Column, end: Column) -> Column:
        return let(F.floor(start / BLOCK).cast("int"), lambda b: F.substr(
            F.concat(F.coalesce(F.get(blocks, b), F.lit("")), F.coalesce(F.get(blocks, b + 1), F.lit(""))),
            (start - b * BLOCK + 1).cast("int"), (end - start).cast("int")))

    def cut(blocks: Column) -> Column:
        return F.transform(spans, lambda s: s.withField("before", piece(blocks, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]))
                           .withField("after", piece(blocks, s["end"], s["end"] + CONTEXT)))

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != F.lit(""))
    weighed = F.transform(each, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    """The check of a base match beyond its form."""
    if kind == "ip":
        def small(p: Column) -> Column:
            p = F.ltrim(p, F.lit("0"))
            return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
        return F.forall(F.split(s, r"\."), small)
    if kind == "card":
        return luhn(digits(s))
    if kind == "phone":
        return F.length(digits(s)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end, surface>>: the base spans by start, then kind
    (``k``: its place in KINDS)."""
    def of_kind(k: int, kind: str) -> Column:
        spans = F.filter(located(text, FORMS[kind]), lambda s: passes(kind, s["surface"]))
        if NEEDS[kind]:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(_SPAN))
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), s["surface"].alias("surface")))

    return F.array_sort(F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)]))


_CANDIDATES = "array<struct<start: bigint, end: bigint, surface: string, at: bigint>>"


def candidates(text: Column) -> Column:
    """array<struct<start, end, surface, at>>: the words with a digit or an
    ``@``, and in runs of number words each stretch of RUN_DIGITS digits, without
    the punctuation around them. Those that start with the same word, at ``at``,
    are readings of one instance."""
    # an opening bracket stays before digits that it closes within the span, a closing one after them
    lead, trail = r"^(?:(?!\([0-9]+\).*[0-9])[^\p{L}0-9@+])+", r"(?:(?!(?<=\([0-9]{1,19})\)$)[^\p{L}0-9])+$"

    def core(start: Column, end: Column, surface: Column, at: Column) -> Column:
        return let(F.regexp_replace(surface, lead, ""), lambda x: let(F.regexp_replace(x, trail, ""), lambda y: F.struct(
            (start + F.char_length(surface) - F.char_length(x)).alias("start"), (end - F.char_length(x) + F.char_length(y)).alias("end"),
            y.alias("surface"), at.alias("at"))))

    def stretches(m: Column) -> Column:
        def of(w: Column, d: Column) -> Column:  # the words, and the digits before each and before the end
            def from_word(i: Column) -> Column:
                last = F.sequence(i, F.least(i + RUN_DIGITS[1], F.size(w)) - 1)
                fit = F.filter(last, lambda j: (j == i) | (F.get(d, j + 1) - F.get(d, i)).between(*RUN_DIGITS))
                return F.transform(fit, lambda j: core(
                    m["start"] + F.get(w, i)["start"], m["start"] + F.get(w, j)["end"],
                    F.array_join(F.transform(F.slice(w, i + 1, j - i + 1), lambda x: x["surface"]), " "), m["start"] + F.get(w, i)["start"]))
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), from_word))

        return let(located(m["surface"], r"[^\x20]+"), lambda w: let(
            running_sums(F.concat(F.transform(w, lambda x: F.length(digits(x["surface"])).cast("long")), F.array(F.lit(0).cast("long")))),
            lambda d: of(w, d)))

    def readings(m: Column) -> Column:
        return F.when(F.contains(m["surface"], F.lit(" ")), stretches(m)).otherwise(F.array(core(m["start"], m["end"], m["surface"], m["start"])))

    return F.filter(F.flatten(F.transform(located(text, f"{RUN}|{CANDIDATE}"), readings)).cast(_CANDIDATES), lambda s: s["end"] > s["start"])


def suits(surface: Column, k: Column) -> Column:
    """From 0 to 1, how well the letters and digits of ``surface`` suit the kind:
    an address has an ``@``; an IP address has four groups of digits; the digits
    of a card or phone number are as many as those have, or in proportion less.
    Neither their grouping nor their punctuation counts."""
    n, long = F.length(digits(surface)), F.char_length(surface)
    share = 1 - F.char_length(F.regexp_replace(surface, r"[^\p{L}]", "")) / long
    groups = F.regexp_count(surface, F.lit("[0-9]+"))

    def within(low: int, high: int) -> Column:
        return F.least(F.lit(1.0), n / low, high / F.greatest(n, F.lit(1)))

    fit = {"ip": F.least(F.lit(1.0), groups / IP_GROUPS), "card": within(*CARD_DIGITS), "phone": within(*PHONE_DIGITS)}
    weighed = F.lit(0.0)
    for kind, w in fit.items():
        weighed = F.when(k == KINDS.index(kind), share * w).otherwise(weighed)
    address = F.when(k == KINDS.index("email"), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.contains(surface, F.lit("@")), address).otherwise(weighed)


def patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: the two words before it, and one
    word on either side; words without the punctuation around them."""
    def bare(s: Column) -> Column:
        each = F.transform(F.split(F.lower(s), f"[{WS_CLASS}]+", -1), lambda w: F.regexp_replace(w, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""))
        return F.filter(each, lambda w: w != F.lit(""))

    left, right = bare(before), bare(after)
    one, two = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("^")), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("^"))
    next_word = F.coalesce(F.get(right, F.lit(0)), F.lit("$"))
    return F.array(F.concat_ws("\t", F.lit("2"), two, one), F.concat_ws("\t", F.lit("1"), one, next_word))


def graph(occurrences: DataFrame) -> DataFrame:
    """pattern, slot, surface, k: distinct edges; ``slot`` is the instance that
    the surface is a reading of; ``k`` is the kind if the surface is a seed (the
    first in KINDS where it is several), else null."""
    return (occurrences.select(F.explode(patterns(F.col("before"), F.col("after"))).alias("pattern"), "slot", "surface", "k")
            .groupBy("pattern", "slot", "surface").agg(F.min("k").alias("k")))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """surface, k, score: the new instances that score at least INSTANCE_SCORE;
    None if no pattern is good enough to find any. Rounds end early once they
    change nothing."""
    by_kind = [F.max(F.when(F.col("k") == k, F.col("score"))).alias(f"g{k}") for k in range(len(KINDS))]
    totals = [F.sum(f"g{k}").alias(f"g{k}") for k in range(len(KINDS))]
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("good")) for k in range(len(KINDS))])
    seeds = materialize(edges.filter("k is not null").groupBy("surface").agg(F.min("k").alias("k")).withColumn("score", F.lit(1.0)), "pii-seeds")
    known, found, before = seeds, None, None
    for _ in range(rounds):
        # a pattern's score: identifiers among its distinct instances
        met = (edges.select("pattern", "slot", "surface").join(known, "surface", "left").groupBy("pattern", "slot").agg(*by_kind)
               .groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *totals))
        rated = met.select("pattern", "n", F.inline(kinds)).withColumn("p", F.col("good") / (F.col("n") + 1))
        scored = materialize(rated.filter((F.col("p") >= PATTERN_SCORE) & (F.col("good") >= SUPPORT)).select("pattern", "k", "p"), "pii-scored")
        if scored.isEmpty():
            return None
        # an instance's score: noisy or over its patterns, as far as it suits the kind; the best kind counts
        votes = (edges.filter("k is null").select("pattern", "surface").distinct().join(scored, "pattern")
                 .groupBy("surface", "k").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"))
                 .withColumn("score", F.col("score") * suits(F.col("surface"), F.col("k"))).filter("score > 0"))
        best = votes.groupBy("surface").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
        found = materialize(best.select("surface", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score")).join(
            seeds.select("surface"), "surface", "left_anti"), "pii-found")
        now = found.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("surface", "k", "score")).alias("x")).first()
        if now.n == 0 or now == before:
            break
        known, before = seeds.unionByName(found), now
    return found.filter(F.col("score") >= INSTANCE_SCORE)


def apart(found: DataFrame) -> DataFrame:
    """row, ``added`` (sorted array of start, k, end): spans of ``found`` (row,
    at, start, end, k, score) that don't overlap: of those that start with the
    same word the one with the best score, then the longest; the leftmost first."""
    best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("long"), "start", "end", (-F.col("k")).alias("k"))).alias("b")
    each = found.groupBy("row", "at").agg(best).select("row", "b.start", (-F.col("b.k")).alias("k"), "b.end")
    order = Window.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # stretches of spans that overlap; only within one is the choice made span by span
    clear = F.when(F.coalesce(reached, F.lit(0)) <= F.col("start"), F.lit(1)).otherwise(F.lit(0))
    stretch = F.sum("clear").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = F.array_sort(F.collect_list(F.struct("start", "k", "end")))
    none = F.array().cast("array<struct<start: bigint, k: int, end: bigint>>")
    chosen = F.aggregate("held", none, lambda kept, s: F.when(
        (F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(kept))
    return (each.withColumn("clear", clear).withColumn("stretch", stretch).groupBy("row", "stretch").agg(held.alias("held"))
            .groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(chosen))).alias("added")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans (start, k, end, ..), comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of start, k, end, sorted; ``k``
    is the place in KINDS), one row per input row.

    ``spans`` has the base spans and those that the patterns add, none of which
    overlaps a base span or another added one. A null text counts as empty and has none; ids are
    passed on, null or repeated; repeated rows have the same spans. Other
    columns are ignored; an empty table gives an empty table.
    """
    text = text_of(text_col)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
                       .select("row", "doc_id", in_context(F.col("text"), base_spans(F.col("text"))).alias("base"),
                               in_context(F.col("text"), candidates(F.col("text"))).alias("words")), "pii-spans")
    seeds = rows.select("row", F.explode("base").alias("s")).select("row", "s.*").withColumn("at", F.col("start"))
    words = rows.select("row", F.explode("words").alias("s")).select("row", "s.*").withColumn("k", F.lit(None).cast("int"))
    order = Window.partitionBy("row").orderBy("start", F.col("k").asc_nulls_last())
    base_end = F.max(F.when(F.col("k").isNotNull(), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # backwards, as frames that shrink are summed anew for every row
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("k").asc_nulls_last())
    base_start = F.min(F.when(F.col("k").isNotNull(), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = (seeds.select("row", "at", "start", "k", "end", "surface", "before", "after").unionByName(words)
             .withColumns({"_e": base_end, "_s": base_start})
             .filter(F.col("k").isNotNull() | (F.coalesce("_e", F.lit(0)) <= F.col("start")) & (F.coalesce("_s", F.col("end")) >= F.col("end"))).drop("_e", "_s"))
    # the longest reading that no base span overlaps names the instance
    longest = F.max(F.struct(F.char_length("surface"), "surface")).over(Window.partitionBy("row", "at", F.col("k").isNull()))
    every = every.withColumn("slot", F.when(F.col("k").isNotNull(), F.col("surface")).otherwise(longest["surface"]))
    every = materialize(every, "pii-occurrences")
    plain = rows.select("row", "doc_id", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))).alias("base"))
    found = bootstrap(materialize(graph(every), "pii-graph"))
    if found is None:
        return plain.select("doc_id", "base", F.col("base").alias("spans"))
    added = apart(every.filter("k is null").select("row", "at", "start", "end", "surface").join(found, "surface"))
    out = plain.join(materialize(added, "pii-added"), "row", "left")
    return out.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))
