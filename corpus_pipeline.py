"""From raw documents to token ids: classify, deduplicate, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again before the next one. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import bpe, grace_dedup, mixing, nbsvm, queries, simhash_trie
from docsift.llm.common import hex_digest, materialize, read

#: Words in a block of the mix: most documents fit in a few.
BLOCK_WORDS = 256

#: The classifier, fingerprints, draws and merges have no SQL form; the tests
#: hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the quality classifier rejects. It is fitted
    on ``docs`` and the labels of ``sf_dir``."""
    return nbsvm.accept(docs, nbsvm.train(docs, read(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return grace_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked."""
    return simhash_trie.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, by document; ``n_chars`` is that of the new text."""
    taken = mixing.mixed_texts(docs, mixing.mix(docs, block_words=BLOCK_WORDS))
    return taken.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed, see ``bpe``), and the digest of the decoded bytes."""
    coded = bpe.round_trip(docs, *queries.multilingual_vocabulary())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", hex_digest(F.col("decoded")).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
