"""The driver's parquet tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_REFERENCE = re.compile(r"\b(from|join)\s+([a-z_]+)\b", flags=re.IGNORECASE)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def referenced_tables(sql: str) -> list[str]:
    """Driver tables named after FROM / JOIN in ``sql``."""
    names = (m[1].lower() for m in _REFERENCE.findall(sql))
    return [n for n in dict.fromkeys(names) if n in TABLES]


def sql_over(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` with the table names after FROM / JOIN bound to ``sf_dir``.

    The tables become temp views whose names hold a digest of the folder, so
    two folders never mix and no view of the user's is replaced. A missing
    table raises, as any other read of a path that isn't there.
    """
    tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
    for name in referenced_tables(text):
        table(spark, sf_dir, name).createOrReplaceTempView(f"docsift_{tag}_{name}")

    def bound(m: re.Match) -> str:
        return f"{m[1]} docsift_{tag}_{m[2].lower()}" if m[2].lower() in TABLES else m[0]

    return spark.sql(_REFERENCE.sub(bound, text))
