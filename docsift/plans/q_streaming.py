"""Streaming jobs run to completion (availableNow) over table-derived files.

Each query writes its input, derived by Spark from the driver tables, into a
fresh folder under the session's checkpoint root, streams it, and returns
what the sink holds. The oracle is the batch result the stream must equal.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.plans.q_dedup import _walk
from docsift.plans.q_round_trips import MODEL, record_fields
from docsift.plans.registry import ORACLE, register
from docsift.session import scratch_dir, write_table
from docsift.sources.fixtures import duckdb_cte, fixture
from docsift.streaming import jobs as SJ


def _paths(spark, name):
    root = scratch_dir(spark, name)
    return {k: os.path.join(root, k) for k in ("input", "sink", "store", "checkpoint")}


@register("stream_seen_urls", duckdb_cte("attempt_log") + "select distinct url from attempt_log")
def stream_seen_urls(spark, sf_dir):
    p = _paths(spark, "seen-urls")
    attempts = fixture(spark, sf_dir, "attempt_log")
    attempts.write.parquet(p["input"])
    q = SJ.seen_urls(spark, p["input"], attempts.schema, p["sink"], p["checkpoint"],
                     max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(p["sink"])


@register("stream_accepted_urls", duckdb_cte("attempt_log") + f"""
select url, cast(2 * attempt as bigint) as seq, case when coalesce(max(case when status_code = 200 then 1 else 0 end)
    over (partition by url order by attempt rows between unbounded preceding and 1 preceding), 0) = 1 then '{SJ.SEEN}' else '{SJ.TAKE}' end as decision
from attempt_log""")
def stream_accepted_urls(spark, sf_dir):
    """Every attempt is an arrival of its URL; the verdict on it comes with it (odd
    attempts) or lands with the next files (even ones)."""
    p = _paths(spark, "accepted-urls")
    attempts = fixture(spark, sf_dir, "attempt_log").select("url", "attempt", F.coalesce(F.col("status_code") == 200, F.lit(False)).alias("good"))
    attempts = write_table(attempts, "accepted-urls-attempts")
    arrival = F.struct((2 * F.col("attempt")).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("accepted"))
    verdict = F.struct((2 * F.col("attempt") + 1).cast("long").alias("seq"), F.col("good").alias("accepted"))
    events = attempts.select("url", "attempt", F.explode(F.array(arrival, verdict)).alias("e")).select("url", "attempt", "e.*")
    # files land in the order of this number
    landing = F.least(F.col("attempt") + F.when((F.col("attempt") % 2 == 0) & F.col("accepted").isNotNull(), 1).otherwise(0), F.lit(4))
    for n in range(1, 5):
        events.filter(landing == n).select("url", "seq", "accepted").write.mode("append").parquet(p["input"])
        SJ.accepted_urls(spark, p["input"], p["sink"], p["checkpoint"]).awaitTermination()
    return spark.read.schema("url string, seq bigint, decision string").parquet(p["sink"]).select("url", "seq", "decision")


@register("stream_label_log", duckdb_cte("model_replies") + f""", j as (select *, case
  when strpos(content, '```json') > 0 then regexp_replace(substring(content, strpos(content, '```json') + 7,
    greatest(case when strpos(substring(content, strpos(content, '```json') + 7), '```') > 0
      then strpos(substring(content, strpos(content, '```json') + 7), '```') - 1
      else length(content) - (strpos(content, '```json') + 7) end, 0)), '^\\s+|\\s+$', '', 'g')
  when strpos(content, '{{') > 0 then case when (case when strpos(content, '}}') > 0 then length(content) - strpos(reverse(content), '}}') + 1 else 0 end) >= strpos(content, '{{')
    then substring(content, strpos(content, '{{'), (length(content) - strpos(reverse(content), '}}') + 1) - strpos(content, '{{') + 1) else '' end
  else content end as json_text from model_replies)
select conv_id, turn, case when error is null then 'ok' else 'error' end as outcome, error from (select *, case
  when exception_kind = 'timeout' then '{C.ERR_TIMEOUT}'
  when exception_kind = 'network' then '{C.ERR_NETWORK_PREFIX}' || exception_kind
  when exception_kind is not null then '{C.ERR_OTHER_PREFIX}' || exception_kind
  when status_code <> 200 then '{C.ERR_STATUS_PREFIX}' || cast(status_code as varchar)
  when not coalesce(json_valid(json_text), false) then '{C.ERR_JSON}'
  when not coalesce(case when json_valid(json_text) then json_type(json_text) = 'OBJECT' end, false)
    then '{C.ERR_OTHER_PREFIX}reply is not a JSON object' end as error from j)""")
def stream_label_log(spark, sf_dir):
    p = _paths(spark, "label-log")
    replies = fixture(spark, sf_dir, "model_replies")
    replies.write.parquet(p["input"])
    q = SJ.label_log(spark, p["input"], replies.schema, p["sink"], p["checkpoint"], keys=("conv_id", "turn"),
                     max_files_per_trigger=2)
    q.awaitTermination()
    schema = "conv_id long, turn long, outcome string, error string, record string"
    return spark.read.schema(schema).json(p["sink"]).select("conv_id", "turn", "outcome", "error")


@register("stream_ordered_log", ORACLE["label_records"].replace("row_number() over (order by conv_id, turn)", "row_number() over (order by conv_id % 2, conv_id, turn)"))
def stream_ordered_log(spark, sf_dir):
    """Even conversations land first, then odd ones; the whole records are compared."""
    p = _paths(spark, "ordered-log")
    name = F.concat(F.lit("img/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".png"))
    replies = write_table(fixture(spark, sf_dir, "model_replies").withColumn("path", name).withColumn("at", F.lit("2024-01-01T00:00:00")), "ordered-log-replies")
    for odd in (0, 1):
        replies.filter(F.col("conv_id") % 2 == odd).write.mode("append").parquet(p["input"])
        SJ.ordered_label_log(spark, p["input"], replies.schema, p["sink"], p["checkpoint"], ("conv_id", "turn"), "path", "at", MODEL).awaitTermination()
    lines = spark.read.schema("conv_id long, turn long, record string").json(os.path.join(p["sink"], "records"))
    return record_fields(lines, "record")


# arrivals: the three blocks of the fingerprint table land one after another
# (first crawl, re-encoded copies, exact re-uploads); the store starts empty
_BLOCKS = 3


@register("stream_incremental_dedup", "with recursive" + duckdb_cte("fingerprints")[len("with"):]
          + ", a as (select row_number() over (order by block, ord) as node, ord, bits from fingerprints), r as (select node, bits from a)"
          + _walk("r") + """
select a.ord as ord, case when is_kept then 'new' else 'duplicate' end as status from walk join a on a.node = walk.node""")
def stream_incremental_dedup(spark, sf_dir):
    p = _paths(spark, "incremental-dedup")
    fp = fixture(spark, sf_dir, "fingerprints").withColumn("file", F.concat(F.lit("f"), F.col("ord").cast("string")))
    for block in range(_BLOCKS):  # the next block lands when the one before is through
        fp.filter(F.col("block") == block).drop("block").write.mode("append").parquet(p["input"])
        q = SJ.incremental_dedup(spark, p["input"], "ord long, bits string, file string", p["store"], p["sink"],
                                 p["checkpoint"], threshold=C.DEFAULT_THRESHOLD, max_files_per_trigger=None)
        q.awaitTermination()
    return spark.read.parquet(p["sink"]).select("ord", "status")
