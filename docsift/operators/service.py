"""Calling an external service from Spark tasks, one result row per input row.

``call_service`` runs a user-supplied client inside ``mapInPandas``: each
task builds one client from ``client_factory`` and calls it per row with up
to ``attempts`` tries and exponential waits (1 s doubling, at most 10 s).
Exceptions become data (``exception_kind`` / ``exception_message``), so one
bad row never fails the task. Parallelism is the number of partitions
(``partitions`` repartitions first).

Spark may re-run a task after an executor loss, and a job may be started again.
``call_once`` keeps a ledger for that: results are committed in small chunks, a
task that runs again skips what its partition's chunks hold, and a job that is
started again calls nothing that is in the ledger. Only the calls of a chunk that
was not committed yet are repeated. ``call_service`` alone keeps no ledger.

Attempts that were stored before are resolved by the same rule in
``resolve_attempts``, without any call.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from docsift.session import write_table
from docsift.sources.image_folder import open_folder

RESULT_SCHEMA = ("{key} {key_type}, status_code int, content string, exception_kind string, "
                 "exception_message string, attempts int")


#: Results are handed on after so many calls, not at the end of a batch.
ROWS_A_YIELD = 16


class CallTimeout(Exception):
    """Raise from a client to report a timeout."""


class CallNetworkError(Exception):
    """Raise from a client to report a network failure."""


def _kind(e: Exception) -> str:
    if isinstance(e, (CallTimeout, TimeoutError)):
        return "timeout"
    if isinstance(e, (CallNetworkError, ConnectionError)):
        return "network"
    return "error"


def _answer(client: Callable[[str], tuple], request: str, attempts: int, base_wait: float, max_wait: float, sleep: Callable[[float], None]) -> tuple:
    """(status, content, exception kind, message, attempts used) of one call."""
    status, content, kind, msg, n = None, None, None, None, 0
    for n in range(1, attempts + 1):
        try:
            status, content = client(request)
            return status, content, None, None, n
        except Exception as e:  # noqa: BLE001 - failures are data
            kind, msg = _kind(e), str(e)
            if n < attempts:
                sleep(min(max_wait, base_wait * 2 ** (n - 1)))
    return status, content, kind, msg, n


def call_service(df: DataFrame, key: str, request: str, client_factory: Callable[[], Callable[[str], tuple]],
                 attempts: int = 3, base_wait: float = 1.0, max_wait: float = 10.0,
                 partitions: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``client(request_text) -> (status_code, content)``; returns the result table."""
    key_type = df.schema[key].dataType.simpleString()
    schema = RESULT_SCHEMA.format(key=key, key_type=key_type)
    src = df.select(key, request)
    if partitions:
        src = src.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in (whole.iloc[at:at + ROWS_A_YIELD] for whole in batches for at in range(0, len(whole), ROWS_A_YIELD)):
            out = [(k, *_answer(client, req, attempts, base_wait, max_wait, sleep)) for k, req in zip(pdf[key], pdf[request])]
            yield pd.DataFrame(out, columns=[key, *_RESULT])

    return src.mapInPandas(run, schema)


_RESULT = ["status_code", "content", "exception_kind", "exception_message", "attempts"]


def _committed(store, folder: str) -> list[str]:
    """Chunk files of one partition, in order; a file counts once it has its name."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("chunk-"))


def _call_partition(rows: Iterator[tuple], folder: str, schema: pa.Schema, client_factory, commit_rows: int, answer) -> int:
    """Call for each (key, request digest, request) that no chunk in ``folder`` holds;
    how many calls were made. Results are committed after ``commit_rows`` calls: a
    file is written under another name and then renamed."""
    store, path, _ = open_folder(folder)
    store.create_dir(path, recursive=True)
    chunks = _committed(store, path)
    done = {pair for c in chunks for pair in zip(*(col.to_pylist() for col in pq.read_table(store.open_input_file(c), columns=schema.names[:2]).columns))}
    n, held, client = len(chunks), [], None

    def commit() -> None:
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
        with store.open_output_stream(f"{path}/.chunk-{n:08d}") as f:
            pq.write_table(table, f)
        store.move(f"{path}/.chunk-{n:08d}", f"{path}/chunk-{n:08d}.parquet")

    called = 0
    for key, digest, request in rows:
        if (key, digest) in done:
            continue
        client = client or client_factory()
        held.append((key, digest, *answer(client, request)))
        called += 1
        if len(held) >= commit_rows:
            commit()
            n, held = n + 1, []
    if held:
        commit()
    return called


def read_ledger(spark: SparkSession, ledger: str, key: str, key_type: str) -> DataFrame:
    """``key, request_md5`` and the result of every committed call; none where the
    ledger isn't there."""
    schema = f"{key} {key_type}, request_md5 string, status_code int, content string, exception_kind string, exception_message string, attempts int"
    try:
        found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "chunk-*.parquet").parquet(ledger)
        found.schema  # noqa: B018 - resolves the path now
        return found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


def call_once(df: DataFrame, key: str, request: str, client_factory: Callable[[], Callable[[str], tuple]], ledger: str, attempts: int = 3,
              base_wait: float = 1.0, max_wait: float = 10.0, partitions: int | None = None, commit_rows: int = 1,
              again: tuple[str, ...] = (), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """As :func:`call_service`, each (key, request) called once whatever is started
    again; the results of ``df``'s rows, from the ledger.

    A key whose request has changed is a new call. Failures are results too, unless
    their kind is in ``again``: those are called anew, and the last result counts.
    A task that is lost repeats at most ``commit_rows`` calls; keep speculative
    execution off, since two attempts that run at once don't see each other. Rows
    that repeat a key and request are one call.
    """
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key), F.md5(F.col(request)).alias("request_md5"), F.col(request).alias("request"))
    stored = read_ledger(spark, ledger, key, key_type)
    settled = stored.filter(F.col("exception_kind").isNull() | ~F.col("exception_kind").isin(*again)) if again else stored
    todo = src.dropDuplicates([key, "request_md5"]).join(settled.select(key, "request_md5"), [key, "request_md5"], "left_anti")
    if partitions:
        todo = todo.repartition(partitions)
    todo = write_table(todo, "calls-todo")  # fixed rows in fixed partitions, for tasks that run again
    schema = to_arrow_schema(stored.schema)
    run_folder = f"{ledger.rstrip('/')}/run-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"

    def answer(client, text):
        return _answer(client, text, attempts, base_wait, max_wait, sleep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        called = _call_partition(rows, f"{run_folder}/part-{TaskContext.get().partitionId()}", schema, client_factory, commit_rows, answer)
        yield pa.RecordBatch.from_arrays([pa.array([called])], names=["n"])

    todo.select(key, "request_md5", "request").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
    results = read_ledger(spark, ledger, key, key_type).withColumn("_run", F.col("_metadata.file_path"))
    last = results.groupBy(key, "request_md5").agg(F.max_by(F.struct(*_RESULT), "_run").alias("r"))  # runs are named by time
    return src.select(key, "request_md5").distinct().join(last, [key, "request_md5"]).select(key, "r.*")


def resolve_attempts(attempts: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Stored attempts (``key``, ``attempt`` from 1, ``status_code``,
    ``exception_kind``) by the rule of a call: the first attempt without an exception
    ends it, whatever its status; after ``most`` the last exception counts. One row
    for each key: key, status_code, exception_kind, attempts."""
    tried = attempts.filter(F.col("attempt") <= most)
    answer = F.min(F.when(F.col("exception_kind").isNull(), F.struct("attempt", "status_code"))).alias("a")
    each = tried.groupBy(key).agg(answer, F.max(F.struct("attempt", "exception_kind")).alias("e"))
    return each.select(key, F.col("a.status_code").alias("status_code"), F.when(F.col("a").isNull(), F.col("e.exception_kind")).alias("exception_kind"),
                       F.coalesce("a.attempt", "e.attempt").alias("attempts"))


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once to a shared table and read back, so that later stages never call."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
