"""Service calls with a fake client; streaming seen-URL suppression."""

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from docsift.operators import replies as R
from docsift.operators.service import CallNetworkError, CallTimeout, call_service, materialize
from docsift.streaming import jobs as SJ


# workers cannot import this test module: ship its functions by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def no_wait(_seconds):
    return None


def make_client():
    calls = {}

    def client(req):
        calls[req] = calls.get(req, 0) + 1
        if req == "timeout":
            raise CallTimeout("read timed out")
        if req == "flaky" and calls[req] < 3:
            raise CallNetworkError("reset")
        if req == "quota":
            return 429, "rate limit"
        return 200, '```json {"document_category": "id_card"} ```'
    return client


def test_call_service_retries_and_failures_as_data(spark, tmp_dir):
    df = spark.createDataFrame([(1, "ok"), (2, "timeout"), (3, "flaky"), (4, "quota")], "id long, req string")
    out = call_service(df, "id", "req", make_client, sleep=no_wait, partitions=2)
    out = materialize(out, os.path.join(tmp_dir, "calls"))
    got = {r.id: (r.status_code, r.exception_kind, r.attempts) for r in out.collect()}
    assert got == {1: (200, None, 1), 2: (None, "timeout", 3), 3: (200, None, 3), 4: (429, None, 1)}
    labels = R.with_outcome(out).select("id", F.col("o.error").alias("error")).collect()
    errors = {r.id: r.error for r in labels}
    assert errors == {1: None, 2: "API request timed out", 3: None, 4: "API请求失败: 429"}


def test_stream_seen_urls(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    spark.createDataFrame([("a",), ("b",)], "url string").write.parquet(src)
    spark.createDataFrame([("b",), ("c",), ("a",)], "url string").write.mode("append").parquet(src)
    q = SJ.seen_urls(spark, src, "url string", os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"),
                     max_files_per_trigger=1)
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()) == ["a", "b", "c"]


def test_a_replayed_batch_gives_the_same_statuses_and_store(spark, tmp_dir):
    """Losing the sink's commit makes Spark run the batch again: the batch
    ignores what it stored the first time."""
    src, store, sink, ck = (os.path.join(tmp_dir, x) for x in ("in", "store", "sink", "ck"))
    rows = [(i, format((1 << 40) * (i // 2) + i % 2, "064b"), f"f{i}") for i in range(8)]
    spark.createDataFrame(rows, "ord long, bits string, file string").write.parquet(src)

    def run():
        SJ.incremental_dedup(spark, src, "ord long, bits string, file string", store, sink, ck, max_files_per_trigger=None).awaitTermination()
        return ({r.ord: r.status for r in spark.read.parquet(sink).collect()}, sorted(r.file for r in spark.read.parquet(store).collect()))

    first = run()
    assert set(first[0]) == set(range(8)) and first[0][0] == "new" and first[0][1] == "duplicate"
    commits = os.path.join(ck, "commits")
    for name in os.listdir(commits):
        os.rename(os.path.join(commits, name), os.path.join(tmp_dir, f"lost-{name}"))
    assert run() == first


class _State:
    """The state of one URL, as the stream's function sees it."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timer = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timer = ms


def _decide(state, events, hold_ms=None):
    import pandas as pd

    frames = [pd.DataFrame([e], columns=["seq", "accepted"]).astype({"accepted": "object"}) for e in events]
    return [(r.seq, r.decision) for f in SJ.decide_url(("u",), iter(frames), state, hold_ms) for r in f.itertuples()]


def test_a_url_is_seen_only_once_accepted():
    s = _State()
    assert _decide(s, [(2, None), (1, None)]) == [(1, SJ.TAKE), (2, SJ.IN_HAND)]
    assert _decide(s, [(3, None)]) == [(3, SJ.IN_HAND)]
    assert _decide(s, [(4, False)]) == [] and not s.exists  # rejected: nothing is kept
    assert _decide(s, [(5, None), (6, True), (7, None)]) == [(5, SJ.TAKE), (7, SJ.SEEN)]
    assert _decide(s, [(8, False), (9, None)]) == [(9, SJ.SEEN)] and s.value == (True,)


def test_a_verdict_that_does_not_come_frees_the_url():
    s = _State()
    assert _decide(s, [(1, None)], 1000) == [(1, SJ.TAKE)] and s.timer == 1000
    s.hasTimedOut = True
    assert _decide(s, [], 1000) == [] and not s.exists
    s.hasTimedOut = False
    assert _decide(s, [(2, None)], 1000) == [(2, SJ.TAKE)]


def test_accepted_urls_stream_survives_restarts(spark, tmp_dir):
    src, sink, ck = (os.path.join(tmp_dir, k) for k in ("src", "sink", "ck"))
    schema = "url string, seq bigint, accepted boolean"
    for rows in ([("a", 1, None), ("b", 1, None)], [("a", 2, False), ("b", 2, True)], [("a", 3, None), ("b", 3, None), ("c", 1, None), ("c", 2, None)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        SJ.accepted_urls(spark, src, sink, ck).awaitTermination()
    got = {(r.url, r.seq): r.decision for r in spark.read.parquet(sink).collect()}
    assert got == {("a", 1): "take", ("b", 1): "take", ("a", 3): "take", ("b", 3): "seen", ("c", 1): "take", ("c", 2): "in_hand"}


def test_processing_order_goes_on_across_batches_and_replays(spark, tmp_dir):
    import json
    import shutil

    src, sink, ck = (os.path.join(tmp_dir, k) for k in ("src", "sink", "ck"))
    schema = "id bigint, path string, status_code int, exception_kind string, content string"

    def land(ids):
        rows = [(i, f"img/{i}.png", 200 if i % 3 else 500, None, '{"document_category":"c"}') for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)

    def run():
        SJ.ordered_label_log(spark, src, schema, sink, ck, ("id",), "path").awaitTermination()
        found = spark.read.schema("id long, record string").json(f"{sink}/records").collect()
        return {r.id: json.loads(r.record)["_file_info"]["processing_order"] for r in found}

    land([5, 3, 9])
    assert run() == {3: 1, 5: 2, 9: 3}
    land([4, 1])
    want = {3: 1, 5: 2, 9: 3, 1: 4, 4: 5}
    assert run() == want
    # the last batch is lost from the checkpoint's commits, and runs again
    for name in ("1", ".1.crc"):
        shutil.move(f"{ck}/commits/{name}", f"{tmp_dir}/commit{name}")
    assert run() == want
    land([2])
    assert run() == want | {2: 6}


def test_urls_of_a_batch_are_decided_as_one_by_one(spark, tmp_dir, monkeypatch):
    """Several batches, a written state of all URLs among them, a batch that runs again."""
    import random

    import pytest

    monkeypatch.setattr(SJ, "ALL_URLS_EVERY", 2)
    rnd, src, sink, ck = random.Random(4), *(os.path.join(tmp_dir, k) for k in ("src", "sink", "ck"))
    states, want = {}, []
    for batch in range(5):
        rows = [(rnd.choice([*"abcdefgh", None]), 10 * batch + i // 9, rnd.choice([None, None, True, False, False])) for i in range(45)]
        rows = list({(u, s): (u, s, v) for u, s, v in rows}.values())
        spark.createDataFrame(rows, "url string, seq bigint, accepted boolean").write.mode("append").parquet(src)
        SJ.accepted_urls(spark, src, sink, ck).awaitTermination()
        for url in {r[0] for r in rows}:
            state = states.setdefault(url, _State())
            want += [(url, *d) for d in _decide_as(url, state, [r[1:] for r in rows if r[0] == url])]
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(sink).select("url", "seq", "decision").collect()), key=repr)
    assert read() == sorted(want, key=repr)
    for name in ("4", ".4.crc"):
        os.rename(os.path.join(ck, "commits", name), os.path.join(tmp_dir, f"lost-{name}"))
    SJ.accepted_urls(spark, src, sink, ck).awaitTermination()
    assert read() == sorted(want, key=repr)
    assert not os.path.exists(os.path.join(ck, "urls", "batch_id=0")) and os.path.exists(os.path.join(ck, "urls", "batch_id=4"))
    with pytest.raises(Exception, match="an event has no seq"):
        spark.createDataFrame([("a", None, None)], "url string, seq bigint, accepted boolean").write.mode("append").parquet(src)
        SJ.accepted_urls(spark, src, sink, ck).awaitTermination()


def _decide_as(url, state, events):
    import pandas as pd

    frame = pd.DataFrame(events, columns=["seq", "accepted"]).astype({"accepted": "object"})
    return [(r.seq, r.decision) for f in SJ.decide_url((url,), iter([frame]), state, None) for r in f.itertuples()]


def test_urls_are_decided_without_a_python_call_each(spark):
    events = spark.createDataFrame([("a", 1, None, 0)], "url string, seq bigint, accepted boolean, now bigint")
    left = spark.createDataFrame([("a", False, 5)], "url string, accepted boolean, until bigint")
    found = SJ.decided(events, left, 7)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert [(r.decision, r.last, r.leaves, r.until) for r in found.collect()] == [(SJ.IN_HAND, True, False, 7)]
    late = SJ.decided(events.withColumn("now", F.lit(5).cast("bigint")), left, 7)
    assert [(r.decision, r.until) for r in late.collect()] == [(SJ.TAKE, 12)]
