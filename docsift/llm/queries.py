"""The registered queries of this subpackage: one per operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import alignment, bpe, chat_tree, grace_dedup, line_dedup, mixing, nbsvm, periodic, pii, quality_rules, quality_sql, simhash_trie, toxicity, winnowing
from docsift.llm.common import hex_digest, let, read, text_of, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: DuckDB: character class of the white space that all operators use.
_WS = r"[\x20\x09-\x0D]"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


@query("op1_bootstrapped_pii")
def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(read(spark, sf_dir, "documents"))

    def count(k: int, kind: str):
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count(k, kind) for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, hex_digest(pii.joined(F.col("base"))).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query("op2_adaptive_quality", quality_sql.statement())
def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
CONTROL = (-1, "<|im_end|><|im_start|>assistant ok")


@query("op3_chat_prefix_tree", r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|'))
                + 2 * len(regexp_extract_all(role, '[%\n]'))) as bigint) as formatted_chars
from c group by conv_id""")
def op3_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL[0], i, role, CONTROL[1]) for i, role in enumerate(("user", "assistant"))], table.schema)
    return chat_tree.read_back(chat_tree.build(table.unionByName(control)))


@query("op4_ftrl_toxicity")
def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query("op5_line_windows", rf"""
with l as (
  select doc_id, x.i - 1 as i, x.line as line
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda v, i: {{'line': v, 'i': i}})) as x from documents)),
f as (
  select doc_id, i as first, lead(i, 2) over w as last, line || chr(10) || lead(line, 1) over w || chr(10) || lead(line, 2) over w as passage
  from l where regexp_matches(line, '[^\x20\x09-\x0D]') window w as (partition by doc_id order by i)),
r as (
  select doc_id, first, last, row_number() over (partition by passage order by doc_id nulls last, first) as nth
  from f where last is not null),
gone as (
  select distinct doc_id, unnest(range(first, last + 1)) as i from r where nth > 1)
select l.doc_id as doc_id, count(*) as n_lines, count(gone.i) as n_removed,
       sha256(coalesce(string_agg(case when gone.i is null then line end, chr(10) order by l.i), '')) as text_sha256
from l left join gone on gone.doc_id = l.doc_id and gone.i = l.i group by l.doc_id""")
def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_repeated(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", hex_digest(F.col("text")).alias("text_sha256"))


def multilingual_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read(spark, sf_dir, "documents"), *multilingual_vocabulary())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        hex_digest(F.col("ids")).alias("ids_sha256"), hex_digest(F.col("decoded")).alias("decoded_sha256"))


@query("op7_grace_dedup", rf"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}+', '', 'g')) as text_sha256,
         length(coalesce(text, '')) as points
  from documents),
k as (
  select text_sha256, count(*) as group_size, first(doc_id order by points desc, doc_id nulls last) as keep_id
  from n group by all)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
from n join k using (text_sha256)""")
def op7_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_groups(read(spark, sf_dir, "documents"))


@query("op8_simhash_trie")
def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(read(spark, sf_dir, "documents"))


@query("op10_mix_sources")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents")).documents
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_nbsvm_quality")
def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, read(spark, sf_dir, "labels")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where in a tenth of the documents (by the CRC-32 h of
    the id) the words from word a = h/10 mod n on repeat with a period that fits
    three to ten times."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        at = (g % n).cast("int")
        period = (1 + F.floor((n - at) / (3 + g % 8))).cast("int")
        place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < at, i).otherwise(at + (i - at) % period)))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    return docs.select("doc_id", F.when(h % 10 == 0, let(words(text_of()), planted)).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        hex_digest(listed).alias("runs_sha256"), hex_digest(F.col("collapsed")).alias("collapsed_sha256"))


@query("op12_winnowing")
def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.against_next(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", winnowing.printed(F.col("fingerprint")).alias("fingerprint"),
                        winnowing.printed(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def paired_vocabularies() -> tuple[str, str]:
    """Paths of the two vocabularies that op13 aligns."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(read(spark, sf_dir, "documents"), *paired_vocabularies())
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(hex_digest(F.col("groups")))
    rated = alignment.rate(aligned.withColumn("groups_sha256", digest))
    return rated.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
