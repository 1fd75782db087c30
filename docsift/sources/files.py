"""File sources: image folders, JSON-lines logs, URL lists, the hash store.

Image folders are listed by the data source of ``image_folder``, which also
reads names that Spark's file sources hide. Names and sizes are filtered in the
listing; contents are only read for files that survive.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators.hash_index import HashIndex
from docsift.operators.numbering import with_position
from docsift.sources.image_folder import list_images


def _suffix(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"(\.[^./]*)$", 1)


def scan_images(spark: SparkSession, folder: str | list[str], flavour: str = "label",
                min_bytes: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Image files of a folder or several (not recursive): ``path, name, length``.

    ``label``: lower-cased suffix in jpg, jpeg, png, webp, bmp, tiff.
    ``extract``: case-sensitive jpg, jpeg, png, webp, ranked in that order.
    ``dedup``: those four suffixes in lower or upper case only.
    Names may start with any character. Size bounds hold in the listing; see
    ``image_folder.with_content`` for the bytes.
    """
    folders = [folder] if isinstance(folder, str) else folder
    exact = [g[1:] for g in C.EXTRACTION_SCAN_GLOBS]
    suffixes = {"label": C.LABEL_SCAN_SUFFIXES, "extract": exact, "dedup": [*exact, *(s.upper() for s in exact)]}[flavour]
    df = list_images(spark, folders, suffixes, flavour == "label", min_bytes, max_bytes)
    if flavour == "extract":
        rank = F.lit(len(exact))
        for i, s in reversed(list(enumerate(exact))):
            rank = F.when(_suffix() == s, F.lit(i)).otherwise(rank)
        df = df.withColumn("ext_rank", rank)
    return df


def number_files(files: DataFrame, flavour: str = "label") -> DataFrame:
    """``files`` without ``content``, with the 1-based ``processing_order`` (by
    path; extraction by suffix rank, path). Join on the path where it is needed:
    no image bytes go through the exchange."""
    order = ["ext_rank", "path"] if flavour == "extract" else ["path"]
    return with_position(files.drop("content"), order, "processing_order", start=1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``file`` and 1-based ``line_no`` per file, blank lines kept.

    Lines of one file come out of its splits in offset order, so
    (file, monotonically increasing id) orders them; positions are then
    made dense per file without a single-task window.
    """
    raw = (spark.read.text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
                   F.monotonically_increasing_id().alias("_mid")))
    numbered = with_position(raw, ["file", "_mid"], "_pos", start=0)
    first = numbered.groupBy("file").agg(F.min("_pos").alias("_first"))
    return (numbered.join(first, "file")
            .select("file", (F.col("_pos") - F.col("_first") + 1).alias("line_no"), "line"))


def read_strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Dataset loader: every line must be valid JSON (any bad line fails the job)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URL list: trimmed non-blank lines with their 0-based list position ``ord``."""
    lines = read_lines(spark, path).select("file", "line_no", J.strip_ws(F.col("line")).alias("url"))
    kept = lines.filter(F.length("url") > 0)
    return with_position(kept, ["file", "line_no"], "ord", start=0).select("ord", "url")


STORE_SCHEMA = "hash bigint, bits string, file string, ord long, batch_id long"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint store; a path that isn't there is an empty store, any other
    error (permissions, network, a corrupt file) is raised, at the latest when
    the rows are read."""
    try:
        df = spark.read.schema(STORE_SCHEMA).parquet(path)
        df.schema  # noqa: B018 - resolves the path now
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], STORE_SCHEMA)


def store_index(spark: SparkSession, path: str, threshold: int = C.DEFAULT_THRESHOLD) -> HashIndex:
    """The index beside the store at ``path``. A store that has none yet (imported,
    or from before there were indexes) gets one, batch by batch."""
    index = HashIndex(spark, f"{path.rstrip('/')}-index-{threshold}", threshold)
    if index.generation() is None:
        store = read_store(spark, path)
        for r in store.select("batch_id").distinct().orderBy("batch_id").collect():
            index.append(store.filter(F.col("batch_id") == r.batch_id).select("hash"), r.batch_id)
    return index


def import_store_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object ``{hex hash: file}`` as store rows.

    Read by lines, since the object may be far larger than one row can be: an
    object on one line, or one entry on each line.
    """
    line = F.regexp_replace(J.strip_ws(F.col("value")), ",$", "")
    opened = F.when(line.startswith("{"), line).otherwise(F.concat(F.lit("{"), line))
    closed = F.when(opened.endswith("}"), opened).otherwise(F.concat(opened, F.lit("}")))
    m = F.try_variant_get(F.try_parse_json(closed), "$", "map<string,string>")
    pairs = spark.read.text(path).select(F.explode(m).alias("hash_hex", "file"))
    h = F.conv("hash_hex", 16, -10).cast("bigint")
    bits = F.lpad(F.conv("hash_hex", 16, 2), 64, "0")
    return pairs.select(h.alias("hash"), bits.alias("bits"), "file",
                        F.lit(None).cast("long").alias("ord"), F.lit(0).cast("long").alias("batch_id"))
