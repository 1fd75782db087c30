"""Chat formatting as a prefix tree of conversations.

Conversations that share their first turns share the nodes of those turns. The
tree is laid out depth first in one stream of characters, each node's text
once. A node has its place in the stream, the position id of its first
character (as if its conversation stood alone), and the intervals of the stream
that it may attend to beside itself: its ancestors, adjacent ones merged.

Layout without walking the tree: conversations are sorted by their paths of
node hashes, which is a depth-first order of their leaves. A node is emitted by
the first conversation that has it, so nodes sorted by (that conversation,
depth) are in depth-first order, and running sums give their places. Sums run
in two steps. A conversation is read as a sorted stream, never as one row; a
conversation's path (16 bytes a turn) is.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. In roles and
texts, ``<`` followed by k backslashes and ``|`` gets one backslash more, so no
control string can stand there and the change can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import materialize, scale_partitions

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Conversations whose new nodes are summed together, and bytes in an Arrow batch that a task returns.
RANGE, OUT_BYTES = 256, 4 << 20

_GUARD, _UNGUARD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also without newlines, so that the role ends at the first one."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the range of its loss mask (empty: -1, -1)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (-1, -1)
    return f"{head}{body}{END}\n", *loss


def parse(formatted: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    head, body = formatted[len(START):-len(END) - 1].split("\n", 1)
    return unescape_role(head), unescape(body)


class Tree(NamedTuple):
    """``nodes``: node, parent (null: first turn), tree (the first turn's node),
    depth, start and end in the stream, position, text, loss_start, loss_end (in
    the text; -1: none), ancestors (array of start, end). ``paths``: conv_id,
    turn_no, node: which nodes a conversation is made of."""

    nodes: DataFrame
    paths: DataFrame


def _stream(df: DataFrame, by: str, order: list, columns: str, step) -> DataFrame:
    """Rows of each ``by`` together and in ``order``, through ``step`` (an
    iterator of row tuples to an iterator of row tuples) in bounded batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(columns))
    big = [i for i, f in enumerate(schema) if pa.types.is_string(f.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for part in (b.slice(at, 1024) for at in range(0, b.num_rows, 1024)):
                    yield from zip(*(c.to_pylist() for c in part.columns))

        made, size = [], 0
        for r in step(rows()):
            made.append(r)
            size += 64 + sum(len(r[i] or "") for i in big)
            if size >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    spread = df.repartition(scale_partitions(df.sparkSession), by).sortWithinPartitions(F.col(by).asc_nulls_first(), *order)
    return spread.mapInArrow(run, columns)


_NEW = object()


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, role, text) in order -> numbered turns with their nodes."""
    now, parent = _NEW, None
    for conv, _, role, text in rows:
        if now is _NEW or conv != now:
            now, parent, tree, no, at = conv, None, None, 0, 0
        role, text = role or "", text or ""
        node = xxhash.xxh3_128_digest((parent or b"") + len(role).to_bytes(8, "big") + role.encode() + text.encode())
        tree = tree or node
        formatted, low, high = piece(role, text)
        yield conv, no, node, parent, tree, at, len(formatted), formatted, low, high
        parent, no, at = node, no + 1, at + len(formatted)


def _ancestors(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, turn_no, node, owned, start, end) in order -> the nodes that the
    conversation owns, with the merged intervals of what is above them."""
    now, above = _NEW, []
    for conv, _, node, owned, start, end in rows:
        if now is _NEW or conv != now:
            now, above = conv, []
        if owned:
            yield node, [{"start": a, "end": b} for a, b in above]
        if above and above[-1][1] == start:
            above[-1] = (above[-1][0], end)
        else:
            above.append((start, end))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank`` 0, 1, ... in ``order``: range partitions, a number in
    each, and the partitions' counts (all that is summed in one place)."""
    n = scale_partitions(df.sparkSession)
    mine = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("_id", F.monotonically_increasing_id()), "ranked")
    mine = mine.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    counts = mine.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    base = materialize(counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "ranked-base")
    return mine.join(base, "_p").withColumn("rank", F.col("base") + F.col("_i")).drop("_p", "_i", "base")


def build(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    """The prefix tree of all conversations (see :class:`Tree`).

    Turns are in the order of ``turn_col``, nulls first; ties, repeated rows
    among them, are separate turns, by role and then text. Rows with a null
    conversation id are one conversation. Null roles and texts count as empty.
    Lengths are in code points of the formatted text. Other columns are
    ignored; an empty table gives empty tables.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    turns = materialize(_stream(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))],
                                f"conv_id {kind}, turn_no bigint, node binary, parent binary, tree binary, position bigint, n bigint, text string, loss_start bigint, loss_end bigint",
                                _turns), "chat-turns")
    paths = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "node"))), lambda s: s["node"]).alias("path"))
    ranks = materialize(ranked(paths, "path", "conv_id").select(F.col("conv_id").alias("_c"), "rank"), "chat-ranks")
    placed = materialize(turns.select("conv_id", "turn_no", "node").join(ranks, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "turn_no", "node", "rank"), "chat-paths")
    owners = placed.groupBy("node").agg(F.min("rank").alias("owner"))
    nodes = turns.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "tree", "position", "n", "text", "loss_start", "loss_end")], F.first("turn_no").alias("depth"))
    nodes = materialize(nodes.join(owners, "node").withColumn("range", F.floor(F.col("owner") / RANGE).cast("long")), "chat-nodes")
    before = Window.unboundedPreceding, -1
    sums = nodes.groupBy("range").agg(F.sum("n").alias("n"))
    base = materialize(sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(*before)), F.lit(0)).alias("base")), "chat-base")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("owner", "depth").rowsBetween(*before)), F.lit(0))
    starts = materialize(nodes.select("range", "node", "owner", "n", inner.alias("inner")).join(base, "range")
                         .select("node", "owner", (F.col("base") + F.col("inner")).alias("start"), (F.col("base") + F.col("inner") + F.col("n")).alias("end")), "chat-starts")
    walked = placed.join(starts, "node").select("conv_id", "turn_no", "node", (F.col("owner") == F.col("rank")).alias("owned"), "start", "end")
    above = materialize(_stream(walked, "conv_id", ["turn_no"], "node binary, ancestors array<struct<start: bigint, end: bigint>>", _ancestors), "chat-ancestors")
    out = nodes.drop("owner", "range", "n").join(starts.drop("owner"), "node").join(above, "node")
    return Tree(materialize(out.select("node", "parent", "tree", "depth", "start", "end", "position", "text", "loss_start", "loss_end", "ancestors"), "chat-tree"),
                placed.drop("rank"))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    now, out = _NEW, None

    def done():
        return now, out[0], out[1].hexdigest(), out[2], out[3].hexdigest(), out[4]

    for conv, _, text, low, high in rows:
        if now is _NEW or conv != now:
            if out:
                yield done()
            now, out = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        role, said = parse(text)
        out[0] += 1
        out[1].update(f"{role}\n{said}\n".encode())
        if low >= 0:
            masked = unescape(text[low:high])
            out[2] += len(masked)
            out[3].update(masked.encode())
        out[4] += len(text)
    if out:
        yield done()


def read_back(tree: Tree) -> DataFrame:
    """Every conversation, read from the nodes on its path: conv_id, n_turns,
    turns_sha256 (of role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (of what the loss mask covers, unescaped), formatted_chars."""
    kind = tree.paths.schema["conv_id"].dataType.simpleString()
    rows = tree.paths.join(tree.nodes.select("node", "text", "loss_start", "loss_end"), "node").select("conv_id", "turn_no", "text", "loss_start", "loss_end")
    return _stream(rows, "conv_id", ["turn_no"], f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", _digests)
