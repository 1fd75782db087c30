"""Each paid call once: tasks and jobs that run again skip what is committed."""

import os

import pytest
from pyspark.sql import functions as F

from docsift.operators import service as S
from docsift.plans import jobs
from tests.test_jobs import noise_png


def counting(folder, die_at=None, fail=()):
    """A client factory whose calls leave a file each; with ``die_at`` a worker ends
    without a word at its call of that number, once."""
    def factory():
        made = [0]

        def client(request):
            made[0] += 1
            if die_at and made[0] == die_at and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                os._exit(1)
            open(f"{folder}/call-{request}-{os.getpid()}-{made[0]}", "w").close()
            if request in fail:
                raise S.CallTimeout("late")
            return 200, f"answer {request}"
        return client
    return factory


def calls(folder):
    return [n.split("-")[1] for n in os.listdir(folder) if n.startswith("call-")]


def requests(spark, n, parts=2):
    return spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("request")).repartition(parts)


def test_a_job_that_dies_is_resumed_without_new_calls(spark, tmp_dir):
    seen, ledger = f"{tmp_dir}/seen", f"{tmp_dir}/ledger"
    os.makedirs(seen)
    with pytest.raises(Exception):
        S.call_once(requests(spark, 40), "key", "request", counting(seen, die_at=9), ledger, partitions=2)
    before = calls(seen)
    assert 8 <= len(before) < 40
    out = S.call_once(requests(spark, 40), "key", "request", counting(seen), ledger, partitions=3)
    assert sorted((r.key, r.content, r.status_code, r.attempts) for r in out.collect()) == [(i, f"answer r{i}", 200, 1) for i in range(40)]
    # commit_rows is 1: at most the call in flight beside the one that died is made again
    assert len(calls(seen)) <= 41 and set(calls(seen)) == {f"r{i}" for i in range(40)}
    n = len(calls(seen))
    assert S.call_once(requests(spark, 40), "key", "request", counting(seen), ledger).count() == 40 and len(calls(seen)) == n
    more = S.call_once(requests(spark, 42), "key", "request", counting(seen), ledger)
    assert more.count() == 42 and len(calls(seen)) == n + 2


def test_a_task_that_runs_again_skips_its_chunks(spark, tmp_dir):
    seen, folder = f"{tmp_dir}/seen", f"{tmp_dir}/ledger/run-1/part-0"
    os.makedirs(seen)
    schema = S.to_arrow_schema(S.read_ledger(spark, f"{tmp_dir}/none", "key", "bigint").schema)
    rows = [(i, f"d{i}", f"r{i}") for i in range(10)]

    def answer(client, request):
        if request == "r7" and len(calls(seen)) == 7:
            raise KeyboardInterrupt  # the task is lost
        return *client(request), None, None, 1

    with pytest.raises(KeyboardInterrupt):
        S._call_partition(iter(rows), folder, schema, counting(seen), 3, answer)
    assert len(calls(seen)) == 7  # two chunks of three are committed, one call isn't
    open(f"{folder}/.chunk-00000002", "w").close()  # a chunk that was never renamed
    assert S._call_partition(iter(rows[::-1]), folder, schema, counting(seen), 3, answer) == 4
    assert sorted(calls(seen)) == sorted([f"r{i}" for i in range(10)] + ["r6"])
    assert S._call_partition(iter(rows), folder, schema, counting(seen), 3, answer) == 0
    assert S.read_ledger(spark, f"{tmp_dir}/ledger", "key", "bigint").count() == 10


def test_changed_requests_failures_and_repeats(spark, tmp_dir):
    seen, ledger = f"{tmp_dir}/seen", f"{tmp_dir}/ledger"
    os.makedirs(seen)
    df = requests(spark, 4).unionAll(requests(spark, 2))  # two rows twice
    nap = {"sleep": lambda s: None}
    first = {r.key: r.exception_kind for r in S.call_once(df, "key", "request", counting(seen, fail=("r1",)), ledger, **nap).collect()}
    assert first == {0: None, 1: "timeout", 2: None, 3: None} and len(calls(seen)) == 3 + 3  # three attempts for r1
    assert S.call_once(df, "key", "request", counting(seen), ledger, **nap).filter("exception_kind is not null").count() == 1
    again = {r.key: r.content for r in S.call_once(df, "key", "request", counting(seen), ledger, again=("timeout",), **nap).collect()}
    assert again[1] == "answer r1" and len(calls(seen)) == 7
    other = df.withColumn("request", F.concat("request", F.lit("x")))
    assert S.call_once(other, "key", "request", counting(seen), ledger, **nap).filter("content like '%x'").count() == 4


def test_label_job_resumes_from_its_ledger(spark, tmp_dir):
    folder, seen, ledger = f"{tmp_dir}/images", f"{tmp_dir}/seen", f"{tmp_dir}/ledger"
    os.makedirs(folder)
    os.makedirs(seen)
    for i in range(5):
        with open(f"{folder}/{i}.png", "wb") as f:
            f.write(noise_png(16, 16, i))

    def factory(die):
        def make():
            def client(request):
                if die and len(os.listdir(seen)) >= 2:
                    os._exit(1)
                open(f"{seen}/call-{len(os.listdir(seen))}", "w").close()
                return 200, '{"document_category":"id"}'
            return client
        return make

    with pytest.raises(Exception):
        jobs.label(spark, folder, factory(True), "p", "m", "t", partitions=1, ledger=ledger).count()
    assert len(os.listdir(seen)) == 2
    out = jobs.label(spark, folder, factory(False), "p", "m", "t", partitions=1, ledger=ledger)
    assert out.count() == 5 and len(os.listdir(seen)) == 5
