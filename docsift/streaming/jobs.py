"""Structured Streaming jobs for the incremental parts of the workflow.

* ``seen_urls``: URLs already handled are suppressed across micro-batches
  (``dropDuplicates`` keeps the URL set as streaming state; with an event
  time column, ``dropDuplicatesWithinWatermark`` bounds that state).
* ``accepted_urls``: a URL is seen only once its image is accepted; until then
  it is in hand, and after a rejection it may come again. A batch meets what the
  batches before left of its URLs in one join, and windows decide it.
* ``label_log``: model replies arriving as files become label records
  appended to a JSON log (append mode, checkpointed); ``ordered_label_log``
  numbers them over all micro-batches.
* ``incremental_dedup``: each micro-batch of hashes is checked against the
  stored hashes, through the store's index, and then against itself; new
  hashes are appended to both under the batch id. A replayed batch ignores
  its own earlier rows, so replay after a failure gives the same answer.

All jobs take a checkpoint folder; with ``available_now`` they process what
is there and stop (tests, backfills), otherwise they keep running.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window

from docsift import constants as C
from docsift.functions import json as J
from docsift.operators import dedup as DD
from docsift.operators import replies as R
from docsift.operators.numbering import with_position
from docsift.session import remove_folders, scratch_scope, write_table
from docsift.sinks.writers import append_store
from docsift.sources.files import store_index


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")


def seen_urls(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
              event_time: str | None = None, watermark: str = "1 day", available_now: bool = True,
              max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    if event_time:
        unique = stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["url"])
    else:
        unique = stream.dropDuplicates(["url"])
    w = unique.select("url").writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(w, available_now).start()


#: What becomes of an arrival: it is fetched, another arrival of it is in hand, or
#: its image was accepted before.
TAKE, IN_HAND, SEEN = "take", "in_hand", "seen"


def decide_url(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, hold_ms: int | None) -> Iterator[pd.DataFrame]:
    """Decisions on one URL's arrivals, in the order of ``seq``: the rule that
    :func:`decided` applies to all URLs of a batch, for use with Spark's keyed state. Events
    are arrivals (``accepted`` null) and verdicts. The state is (accepted): none for a URL that
    is new, was rejected, or whose verdict did not come in ``hold_ms``."""
    if state.hasTimedOut:
        state.remove()
        return
    events = sorted((int(seq), None if pd.isna(verdict) else bool(verdict)) for b in batches for seq, verdict in zip(b["seq"], b["accepted"]))
    known = bool(state.get[0]) if state.exists else None  # None: free, False: in hand, True: accepted
    out = []
    for seq, verdict in events:
        if verdict is None:
            out.append((key[0], seq, TAKE if known is None else SEEN if known else IN_HAND))
            known = bool(known)
        elif not known:  # a verdict on an accepted URL changes nothing
            known = True if verdict else None
    if known is None:
        if state.exists:
            state.remove()
    else:
        state.update((known,))
        if not known and hold_ms is not None:
            state.setTimeoutDuration(hold_ms)
    if out:
        yield pd.DataFrame(out, columns=["url", "seq", "decision"])


#: Every so many batches the URLs of all batches before are written together.
ALL_URLS_EVERY = 16


def left_urls(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """``url, accepted, until`` as the batches before ``batch_id`` leave them in ``path``:
    true for accepted, false for in hand (until that time in ms, null: no end), null for free."""
    schema = "url string, accepted boolean, until bigint, batch_id bigint"
    if batch_id == 0:
        return spark.createDataFrame([], schema).drop("batch_id")
    parts = [f"{path}/batch_id={n}" for n in range(_all_urls_before(batch_id), batch_id)]
    rows = spark.read.schema(schema).option("basePath", path).parquet(*parts)
    return rows.groupBy("url").agg(F.max_by("accepted", "batch_id").alias("accepted"), F.max_by("until", "batch_id").alias("until"))


def _all_urls_before(batch_id: int) -> int:
    return (batch_id - 1) // ALL_URLS_EVERY * ALL_URLS_EVERY


def decided(events: DataFrame, left: DataFrame, hold_ms: int | None) -> DataFrame:
    """The events (url, seq, accepted, now in ms) of a batch with the ``decision`` on an
    arrival, whether the event is the URL's last, and then what it leaves: ``leaves``, ``until``."""
    of_url = left.select(F.col("url").alias("_url"), F.col("accepted").alias("_left"), F.col("until").alias("_until"))
    met = events.join(of_url, F.col("url").eqNullSafe(F.col("_url")), "left")
    came = F.when(F.col("_left") | F.col("_until").isNull() | (F.col("_until") > F.col("now")), F.col("_left"))
    by_seq = Window.partitionBy("url").orderBy("seq", F.col("accepted").asc_nulls_first())
    earlier = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    good = F.coalesce("accepted", F.lit(False))
    # before the event; true stays, else the event before decides: an arrival is in hand, a verdict frees
    known = (F.when(F.coalesce(came, F.lit(False)) | F.coalesce(F.bool_or(good).over(earlier), F.lit(False)), True)
             .when(F.row_number().over(by_seq) == 1, came).when(F.lag("accepted").over(by_seq).isNull(), False))
    decision = F.when(F.col("known").isNull(), TAKE).when(F.col("known"), SEEN).otherwise(IN_HAND)
    leaves = F.when(F.coalesce("known", F.lit(False)) | good, True).when(F.col("accepted").isNull(), False)
    until = F.lit(None).cast("bigint") if hold_ms is None else F.when(~F.col("leaves"), F.col("now") + hold_ms)
    return (met.withColumn("known", known).withColumn("last", F.lead("seq").over(by_seq).isNull())
            .withColumn("leaves", leaves).withColumn("until", until).withColumn("decision", decision)
            .select("url", "seq", "accepted", "decision", "last", "leaves", "until"))


def accepted_urls(spark: SparkSession, source: str, sink: str, checkpoint: str, hold_ms: int | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Events ``url, seq, accepted`` arrive as files: arrivals (``accepted`` null)
    and verdicts on the images of taken ones. ``sink`` gets ``url, seq, decision`` for
    each arrival, by batch id; a batch that runs again replaces its own rows.

    Only accepted URLs become seen: one whose image was rejected (or whose verdict
    does not come within ``hold_ms``, which also frees its state) is taken again when
    it comes again. ``seq`` (never null) orders the events of a URL within a micro-batch; a
    verdict belongs in the batch of its arrival or a later one. What each batch leaves of
    its URLs is kept beside Spark's own files in ``checkpoint``.
    """
    reader = spark.readStream.schema("url string, seq bigint, accepted boolean")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    seq = F.coalesce("seq", F.raise_error(F.lit("an event has no seq")).cast("bigint"))
    # the batch's own time, the same when it runs again
    stream = reader.parquet(source).select("url", seq.alias("seq"), "accepted", F.unix_millis(F.current_timestamp()).alias("now"))
    kept = f"{checkpoint.rstrip('/')}/urls"

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):  # what a batch leaves is in the sink and the checkpoint
            before = left_urls(spark, kept, batch_id)
            rows = write_table(decided(batch, before, hold_ms), "stream-decided")
            rows.filter(F.col("accepted").isNull()).select("url", "seq", "decision").write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
            leaves = rows.filter("last").select("url", F.col("leaves").alias("accepted"), "until")
            if batch_id % ALL_URLS_EVERY == 0:
                others = before.join(leaves.select(F.col("url").alias("_url")), F.col("url").eqNullSafe(F.col("_url")), "left_anti")
                leaves = leaves.unionByName(others).filter(F.col("accepted").isNotNull())
            leaves.write.mode("overwrite").parquet(f"{kept}/batch_id={batch_id}")
            if batch_id % ALL_URLS_EVERY == 1:  # the batch before is through, and holds all that came before it
                remove_folders(spark, [f"{kept}/batch_id={n}" for n in range(max(0, batch_id - 1 - ALL_URLS_EVERY), batch_id - 1)])

    w = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start()


def _records(replies: DataFrame, keys: tuple[str, ...], path_col: str | None, order: Column, timestamp_col: str | None, model: str, flavour: str) -> DataFrame:
    """``keys``, outcome, error and the record's JSON line of each reply."""
    rec = R.with_outcome(replies, flavour)
    if path_col:
        stamp = F.col(timestamp_col) if timestamp_col else F.lit(None).cast("string")
        rec = R.with_metadata(rec, F.col(path_col), None, stamp, model, flavour=flavour)
        rec = R.with_file_info(rec, F.col(path_col), order)
    return R.record_text(rec, "record").select(
        *keys, F.when(F.col("o.has_error"), F.lit("error")).otherwise(F.lit("ok")).alias("outcome"),
        F.col("o.error").alias("error"), "record")


def label_log(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keys: tuple[str, ...],
              path_col: str | None = None, order_col: str | None = None, timestamp_col: str | None = None, model: str = "",
              flavour: str = "label", available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Replies -> ``keys``, outcome, error and the record's JSON line. With
    ``path_col`` the record gets its metadata and file info."""
    J.allow_repeated_keys(spark)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    order = F.col(order_col) if order_col else F.lit(None).cast("int")
    rec = _records(reader.parquet(source), keys, path_col, order, timestamp_col, model, flavour)
    w = rec.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint) \
        .option("ignoreNullFields", "false").outputMode("append")
    return _trigger(w, available_now).start()


def ordered_label_log(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keys: tuple[str, ...], path_col: str,
                      timestamp_col: str | None = None, model: str = "", flavour: str = "label", available_now: bool = True,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """As :func:`label_log`, with the processing order of the whole stream in every
    record: micro-batches one after another, the replies of a batch by ``keys``.

    ``sink/records`` holds the lines by batch id, ``sink/counts`` how many records
    each finished batch has; the counts of the batches before give the first number
    of the next. A batch that runs again replaces its own lines and its own count,
    so it gets the same numbers.
    """
    J.allow_repeated_keys(spark)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = f"{sink.rstrip('/')}/counts"

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):  # what a batch leaves is in the sink
            before = read_counts(spark, counts).filter(F.col("batch_id") < batch_id).agg(F.sum("n")).first()[0] or 0
            numbered = write_table(with_position(batch, list(keys), "_order", start=before + 1), "stream-numbered")
            lines = _records(numbered, keys, path_col, F.col("_order"), timestamp_col, model, flavour)
            (lines.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("ignoreNullFields", "false").partitionBy("batch_id").json(f"{sink.rstrip('/')}/records"))
            (numbered.agg(F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(counts))

    w = reader.parquet(source).writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``n, batch_id`` of the finished batches; none where nothing is written yet."""
    try:
        return spark.read.schema("n bigint, batch_id bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], "n bigint, batch_id bigint")


def incremental_dedup(spark: SparkSession, source: str, schema, store: str, status_sink: str,
                      checkpoint: str, threshold: int = C.DEFAULT_THRESHOLD, available_now: bool = True,
                      max_files_per_trigger: int | None = 1) -> StreamingQuery:
    """Rows ``(ord, bits, file)`` arrive as files; statuses go to ``status_sink``
    (partitioned by batch id), new hashes to the ``store``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    index = store_index(spark, store, threshold)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):  # what a batch leaves is in the sink and the store
            rows = write_table(batch.select("ord", "bits", "file"), "stream-batch")
            status = DD.incremental(rows, index, threshold, but_batch=batch_id)
            (status.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(status_sink))
            written = spark.read.parquet(status_sink).filter((F.col("batch_id") == batch_id) & (F.col("status") == "new"))
            fresh = DD.with_hash(rows).join(written.select("ord"), "ord")
            fresh = write_table(fresh, "stream-fresh")
            append_store(fresh, store, batch_id)
            index.append(fresh, batch_id)

    w = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now).start()
