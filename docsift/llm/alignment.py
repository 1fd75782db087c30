"""Alignment of two tokenizers' ids over the same text.

Both tokenizers encode the whole text. Their tokens end at byte offsets; where
both have an end, the text is cut into groups, and every token of one side in a
group is linked to every token of the other. An end that both share (verified by
the tokens' bytes) right before a token marked with a space is an anchor. Anchors
split a document into windows of ids, mostly a word each. A window's alignment
depends on its ids alone, so it is kept by them. Documents go through in batches:
anchors and equal windows are found over a batch's arrays at once, and each
distinct window of a batch is looked up once.

How many documents hold a pair of ids linked is counted over the corpus, and the
counts go back to every document's links. Pairs that stand in many documents are
joined by a broadcast of at most ``HOT_PAIRS`` rows, all others by a shuffle, so
no frequent pair gathers its documents in one task.

Side A is a byte-level BPE (``tokenizers`` file), side B a ``sentencepiece``
model that puts a space before the text; A gets the same space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import materialize, small_batches, text_of

#: Aligned windows that a worker keeps, in two generations.
CACHE = 200_000
#: Windows with more bytes of ids are worked out each time they occur.
CACHED_BYTES = 256
#: Pairs of occurrences in a group beyond which its ids are counted first.
CROWD = 4096
#: Texts beyond so many characters are encoded in parts (where that gives the same ids).
PART_CHARS = 1 << 20
#: Pairs whose counts are broadcast: those in most documents; the others are joined by a shuffle.
HOT_PAIRS = 1 << 20
#: Rows and characters of text that go through at once.
BATCH_DOCS, BATCH_CHARS = 1000, 2 << 20

# FIXED VALUE: how byte-level BPE files split text before the merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space after anything but white space, unless it ends the text.
_CUT = re.compile(r"(?<=\S) (?!\Z)")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    stands for itself, the others take the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class TwoGenerations:
    """A bounded store: when the new generation is full it becomes the old one."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each length, end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class Vocabulary:
    """Bytes of each token, their number, and whether they start with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.all = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.all[ranges(self.start[ids], self.length[ids])].tobytes()


def _side_a(path: str):
    """(vocabulary, text -> ids) of a ``tokenizers`` file. The library that works on
    ranks is used where the file is a plain byte-level BPE whose ids rise with the
    merges, since it gives the same ids several times faster; else its own library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    letters = byte_letters()
    vocabulary = Vocabulary([bytes(letters[c] for c in own.id_to_token(i)) for i in range(own.get_vocab_size())])
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and made.get("truncation") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) \
        and not split.get("add_prefix_space")
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
    ranked = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if plain and ranked and len(merged) + 256 == len(set(model["vocab"].values()) - {t["id"] for t in made["added_tokens"]}) and all(x < y for x, y in zip(merged, merged[1:])):
        special = {t["id"] for t in made["added_tokens"]}
        ranks = {t: i for i, t in enumerate(vocabulary.tokens) if i not in special}
        fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return vocabulary, lambda text: fast.encode_to_numpy(text, disallowed_special=()), plain
    return vocabulary, lambda text: own.encode(text, add_special_tokens=False).ids, plain


class Aligner:
    """Two tokenizers over ``" " + text``, and the windows that they have met."""

    def __init__(self, a_path: str, b_path: str, cache: int = CACHE):
        import sentencepiece

        self.of_a, self.ids_a, plain = _side_a(a_path)
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.of_b = Vocabulary([bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.ids_b = b.EncodeAsIds
        # Whether a text may be cut before a space that follows other than white space,
        # and its parts encoded alone, with the same ids. Side A: the pattern takes a
        # space at the start of a match only. Side B: no piece has a space after another
        # character, and text is not changed before the merges.
        probe = "ﬁ Á  ½　x① "
        self.cuts = plain and b.normalize(probe) == "▁" + probe.replace(" ", "▁") and not any(re.search("[^▁]▁", p) for p in pieces)
        self.windows = TwoGenerations(cache)
        # "id," and, for the last of a group, "id|" (A) or "id;" (B): 2 * id, then 2 * id + 1
        self.numbers = np.array([f"{i}{mark}".encode() for side, last in ((self.of_a, "|"), (self.of_b, ";")) for i in range(len(side.tokens)) for mark in (",", last)])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if the bytes of a side are not ``" " + text``."""
        none = np.zeros(0, np.uint32)
        if not text:
            return none, none
        parts = [text]
        if len(text) > PART_CHARS and self.cuts:
            at, parts = 0, []
            while cut := _CUT.search(text, at + PART_CHARS):
                parts.append(text[at:cut.start()])
                at = cut.end()
            parts.append(text[at:])
        a, b = (np.concatenate([np.asarray(encode(p), np.uint32) for p in sided]) for encode, sided in ((self.ids_a, [" " + p for p in parts]), (self.ids_b, parts)))
        whole = (" " + text).encode()
        return (a, b) if self.of_a.joined(a) == whole == self.of_b.joined(b) else (none, none)

    def anchors(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start, as places in ``a`` and in ``b``: at the documents' starts
        ``first_a``, and at each space-marked token of A before which B has an end too."""
        starts_a, starts_b = (np.cumsum(side.length[ids]) - side.length[ids] for side, ids in ((self.of_a, a), (self.of_b, b)))
        marked = self.of_a.spaced[a]
        marked[first_a] = True
        marked = np.flatnonzero(marked)
        at = np.minimum(np.searchsorted(starts_b, starts_a[marked]), len(b) - 1)
        shared = starts_b[at] == starts_a[marked]
        return marked[shared], at[shared]

    def _aligned(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Iterator[bytes]:
        """The alignment of each of some windows, whose ids lie end to end, as packed
        numbers: how many groups, their ends in A, in B, pairs (both ids in one
        number), how often each."""
        ends_a, ends_b = np.cumsum(self.of_a.length[a]), np.cumsum(self.of_b.length[b])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        shared = np.flatnonzero(ends_b[at] == ends_a)
        cut_a, cut_b = shared + 1, at[shared] + 1
        from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
        window = np.searchsorted(last_a, from_a, "right")
        n, m = cut_a - from_a, cut_b - from_b
        groups, pairs, times = [window], [], []
        crowd = np.flatnonzero(n * m > CROWD)
        for g in crowd.tolist():  # many tokens on both sides: distinct ids first
            (p, x), (q, y) = (np.unique(ids[i:k], return_counts=True) for ids, i, k in ((a, from_a[g], cut_a[g]), (b, from_b[g], cut_b[g])))
            pairs.append((p.astype(np.int64)[:, None] << 32 | q.astype(np.int64)[None, :]).ravel())
            times.append((x[:, None] * y[None, :]).ravel())
        few = np.setdiff1d(np.arange(len(n)), crowd, assume_unique=True)
        size = n[few] * m[few]
        k = ranges(np.zeros(len(few), np.int64), size)
        row, column = np.divmod(k, np.repeat(m[few], size))
        pairs.append(a[np.repeat(from_a[few], size) + row].astype(np.int64) << 32 | b[np.repeat(from_b[few], size) + column].astype(np.int64))
        times.append(np.ones(len(k), np.int64))
        of = np.concatenate([*(np.full(len(x), window[g]) for x, g in zip(pairs, crowd)), np.repeat(window[few], size)])
        of, pairs, times = summed(of, np.concatenate(pairs), np.concatenate(times))
        rest_a, rest_b = (cut - np.repeat(last - each, np.bincount(window, minlength=len(n_a))) for cut, last, each in ((cut_a, last_a, n_a), (cut_b, last_b, n_b)))
        groups, found = np.bincount(window, minlength=len(n_a)), np.bincount(of, minlength=len(n_a))
        size = 1 + 2 * groups + 2 * found
        end = np.cumsum(size)
        block = np.empty(end[-1], np.int64)
        block[end - size] = groups
        at = end - size + 1
        for part, n in ((rest_a, groups), (rest_b, groups), (pairs, found), (times, found)):
            block[ranges(at, n)] = part
            at = at + n
        packed, bounds = block.tobytes(), [0, *(8 * end).tolist()]
        for i, k in zip(bounds, bounds[1:]):
            yield packed[i:k]

    def _known(self, a, at_a, end_a, b, at_b, end_b) -> list[bytes]:
        """Alignments of distinct windows, from the store where they are kept."""
        n_a, n_b = end_a - at_a, end_b - at_b
        end = np.cumsum(n_a + 1 + n_b)
        start = end - (n_a + 1 + n_b)
        ids = np.full(end[-1], 0xFFFFFFFF, "<u4")  # the ids of A, a mark, the ids of B
        ids[ranges(start, n_a)] = a[ranges(at_a, n_a)]
        ids[ranges(start + n_a + 1, n_b)] = b[ranges(at_b, n_b)]
        packed, bounds = ids.tobytes(), [0, *(4 * end).tolist()]
        keys = [packed[i:k] for i, k in zip(bounds, bounds[1:])]
        known = [self.windows.get(key) for key in keys]
        new = [i for i, found in enumerate(known) if found is None]
        if new:
            n_a, n_b = n_a[new], n_b[new]
            made = self._aligned(a[ranges(at_a[new], n_a)], n_a, b[ranges(at_b[new], n_b)], n_b)
            for i, found in zip(new, made):
                known[i] = found
                if len(keys[i]) <= CACHED_BYTES:
                    self.windows.put(keys[i], found)
        return known

    def _shown(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` of ids whose groups end at ``cut_a`` and ``cut_b``."""
        n, m = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        out = np.empty(len(a) + len(b), np.int64)
        # a token of A stands after the B tokens of the groups before, one of B after the A tokens up to its group
        place_a, place_b = np.arange(len(a)) + np.repeat(cut_b - m, n), np.arange(len(b)) + np.repeat(cut_a, m)
        code_a, code_b = 2 * a.astype(np.int64), 2 * (len(self.of_a.tokens) + b.astype(np.int64))
        code_a[cut_a - 1] += 1
        code_b[cut_b - 1] += 1
        out[place_a], out[place_b] = code_a, code_b
        return self.numbers[out].tobytes().translate(None, b"\0")[:-1].decode()

    def align(self, texts: list[str]) -> dict:
        """n_a, n_b, n_groups, n_links (arrays, one number for each text), groups (list
        of texts), and pair, n, of (arrays): the links of text ``of``."""
        coded = [self.encode(t) for t in texts]
        n_a, n_b = (np.array([len(c[side]) for c in coded], np.int64) for side in (0, 1))
        none = np.zeros(0, np.int64)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(len(texts), np.int64), "n_links": np.zeros(len(texts), np.int64), "groups": [""] * len(texts),
               "pair": none, "n": none, "of": none}
        held = np.flatnonzero(n_a)
        if not len(held):
            return out
        a, b = (np.concatenate([coded[i][side] for i in held]) for side in (0, 1))
        first_a, first_b = np.cumsum(n_a[held]) - n_a[held], np.cumsum(n_b[held]) - n_b[held]
        at_a, at_b = self.anchors(a, b, first_a)
        end_a, end_b = np.append(at_a[1:], len(a)), np.append(at_b[1:], len(b))
        _, first, nth = np.unique(equal_windows(a, at_a, end_a, b, at_b, end_b), return_index=True, return_inverse=True)
        known = self._known(a, at_a[first], end_a[first], b, at_b[first], end_b[first])
        block, size = np.frombuffer(b"".join(known), np.int64), np.fromiter(map(len, known), np.int64, len(known)) // 8
        start = np.cumsum(size) - size
        n_cuts = block[start]
        n_pairs = (size - 1 - 2 * n_cuts) // 2
        # the groups of all windows, in their order
        each = n_cuts[nth]
        at = ranges(start[nth] + 1, each)
        cuts_a, cuts_b = block[at] + np.repeat(at_a, each), block[at + np.repeat(each, each)] + np.repeat(at_b, each)
        # the pairs of each document's distinct windows
        doc = np.searchsorted(first_a, at_a, "right") - 1
        counted, often = np.unique(doc * len(known) + nth, return_counts=True)
        doc_of, window = counted // len(known), counted % len(known)
        each = n_pairs[window]
        at = ranges((start + 1 + 2 * n_cuts)[window], each)
        of, out["pair"], out["n"] = summed(np.repeat(doc_of, each), block[at], block[at + np.repeat(each, each)] * np.repeat(often, each))
        out["of"] = held[of]
        np.add.at(out["n_links"], out["of"], out["n"])
        bounds = np.searchsorted(cuts_a, np.append(first_a, len(a)), "right")
        out["n_groups"][held] = np.diff(bounds)
        for k, (i, g, h, x, y) in enumerate(zip(held.tolist(), bounds.tolist(), bounds[1:].tolist(), first_a.tolist(), first_b.tolist())):
            out["groups"][i] = self._shown(*coded[i], cuts_a[g:h] - x, cuts_b[g:h] - y)
        return out


def summed(of: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (of, pair), sorted, with the sum of their n."""
    order = np.lexsort((pair, of))
    of, pair, n = of[order], pair[order], n[order]
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1]))) if len(of) else np.zeros(0, np.int64)
    return of[first], pair[first], np.add.reduceat(n, first) if len(of) else n


_MIX, _STEP = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


def _hashes(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of ``ids``: the sum of id * step^offset."""
    up = np.full(len(ids) + 1, _STEP, np.uint64)
    down = np.full(len(ids) + 1, pow(_STEP, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return (upto[end] - upto[start]) * down[start]


def equal_windows(a: np.ndarray, at_a: np.ndarray, end_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each window the place of an equal one, the same for all equal windows.
    Hashes propose, the ids decide: a window that differs from the one proposed
    stands for itself."""
    h = _hashes(a, at_a, end_a) * _MIX
    h = (h ^ h >> np.uint64(32)) + _hashes(b, at_b, end_b)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    like = first[inverse]
    same = np.ones(len(like), bool)
    for ids, at, end in ((a, at_a, end_a), (b, at_b, end_b)):
        n = end - at
        same &= n == n[like]
        # as many ids as fit the other window, compared one by one
        n = np.where(same, n, 0)
        differ = ids[ranges(at, n)] != ids[ranges(at[like], n)]
        same[np.repeat(np.arange(len(like)), n)[differ]] = False
    return np.where(same, like, np.arange(len(like)))


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner of two vocabulary files, made once."""
    return Aligner(a_path, b_path)


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``
    (``a1,a2|b1;a3|b2,b3``) and ``links`` (array of a, b and n, how many pairs of
    occurrences are linked); one row per input row.

    The paths are those of files that every worker can open. Null and empty texts,
    and texts whose tokens of either side do not give back the bytes of a space and
    the text, have no tokens, no groups and no links. Strings of special tokens are
    plain text. Repeated rows and null ids are passed on as they are; other columns
    are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def batch(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        made = aligner(a_path, b_path).align(texts)
        ends = np.searchsorted(made["of"], np.arange(len(texts) + 1)).astype(np.int32)
        parts = [pa.array((made["pair"] >> 32).astype(np.int32)), pa.array((made["pair"] & 0xFFFFFFFF).astype(np.int32)), pa.array(made["n"])]
        links = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_LINK)))
        counts = ["n_a", "n_b", "n_groups", "n_links"]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(made[c]) for c in counts), pa.array(made["groups"], pa.string()), links],
                                          names=["doc_id", *counts, "groups", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, texts, size = 0, [], 0
            for i, text in enumerate(b.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1])
                if len(texts) >= BATCH_DOCS or size >= BATCH_CHARS or i + 1 == b.num_rows:
                    yield batch(b.column(0).slice(first, len(texts)), texts)
                    first, texts, size = i + 1, [], 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
                                               "links array<struct<a:int,b:int,n:bigint>>")


def _exploded(aligned: DataFrame) -> DataFrame:
    """row, pair (both ids in one number), n."""
    return (aligned.select("row", F.inline("links")).select("row", (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, held (documents that hold it linked), best (no pair of the same A id is
    held by more)."""
    pairs = materialize(_exploded(aligned).groupBy("pair").agg(F.count(F.lit(1)).alias("held")), "align-pairs").withColumn("a", F.shiftright("pair", 32))
    # one row for each id of A: a vocabulary's size at most
    most = pairs.groupBy("a").agg(F.max("held").alias("most"))
    return materialize(pairs.join(F.broadcast(most), "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "align-counts")


def hot_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are held by as many documents."""
    sizes = counts.groupBy(F.floor(F.log2("held")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 62 rows
    total, p = 0, 62
    for r in sorted(sizes, key=lambda r: -r.p):
        total += r.n
        if total > most:
            break
        p = r.p
    return 1 << p


def rate(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` (from :func:`align`, any further columns as they are) with
    ``n_best``, the links whose pair is held by as many documents as any pair of
    its A id, and ``count_sum``, the sum of these numbers over the links.

    Each row counts as a document, repeated ones too. ``links`` and ``groups`` are
    left out. A column ``row``, ``n_best`` or ``count_sum`` that is there already
    is a ValueError.
    """
    if taken := {"row", "n_best", "count_sum"} & set(aligned.columns):
        raise ValueError(f"columns are there already: {sorted(taken)}")
    kept = [c for c in aligned.columns if c not in ("links", "groups")]
    aligned = materialize(aligned.drop("groups").withColumn("row", F.monotonically_increasing_id()), "align-links")
    counts = pair_counts(aligned)
    links = _exploded(aligned)
    least = hot_from(counts, hot_pairs)
    hot = F.broadcast(counts.filter(F.col("held") >= least))

    def summed(joined: DataFrame) -> DataFrame:
        return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"),
                                         F.sum(F.col("n") * F.col("held")).alias("count_sum"))

    sums = summed(links.join(hot, "pair"))
    if not counts.filter(F.col("held") < least).isEmpty():
        rest = links.join(hot.select("pair"), "pair", "left_anti").join(counts.filter(F.col("held") < least), "pair")
        sums = sums.unionByName(summed(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(sums, "row", "left").select(*kept, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                                                    F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))
