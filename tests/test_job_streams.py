"""Jobs and numbered logs as keyed state: events in any order and batch, timers, and batches that run twice."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parchment.operators import events
from parchment.operators.machines import job_step
from parchment.streaming import jobs

START = datetime(2026, 1, 1)
TABLE = "user_id long, n long, ts timestamp, t_ms long, outcome string, permanent boolean"


def at(seconds):
    return START + timedelta(seconds=seconds), int((START - datetime(1970, 1, 1)).total_seconds() + seconds) * 1000


def plain(rows, now):
    """The jobs of (key, n, seconds, outcome, permanent), each event in order, and then the time being now."""
    of = defaultdict(list)
    for key, n, s, outcome, permanent in rows:
        of[key].append((n, s, outcome, permanent))
    out = {}
    for key, own in of.items():
        job, resumed = {"status": "queued", "attempts": 0, "due": 0}, 0
        for _, s, outcome, permanent in [*sorted(set(own)), (0, now, None, False)]:
            t = at(s)[1]
            if job["status"] == "retrying" and job["due"] <= t:
                job["status"], resumed = "queued", resumed + 1
            job_step(job, outcome, permanent, t)
        out[key] = (max(n for n, *_ in own), job["status"], job["attempts"], resumed)
    return out


def test_jobs_in_any_order(spark):
    import random

    r = random.Random(3)
    rows, seconds = [], 0
    for n in range(1, 25):
        for key in range(6):
            seconds += r.randint(1, 9)
            rows.append((key, n, seconds, r.choice(["start", "start", "error", "error", "done", "cancel", "recover", "other"]), r.random() < 0.2))
    rows += rows[:10]  # events that come again
    r.shuffle(rows)
    df = spark.createDataFrame([(k, n, *at(s), outcome, permanent) for k, n, s, outcome, permanent in rows], TABLE)
    for now in (seconds + 1, seconds + 300):
        got = jobs.run_jobs(df.repartition(7), "user_id", str(at(now)[0]), files_per_trigger=1).collect()
        assert {x.user_id: tuple(x)[1:] for x in got} == plain(rows, now)


def test_a_retry_comes_due_by_its_timer_alone(spark):
    rows = [(1, 1, 0, "start", False), (1, 2, 5, "error", False), (2, 1, 0, "start", False), (2, 2, 5, "error", False), (2, 3, 8, "cancel", False), (3, 2, 6, "error", False), (None, 1, 5, "start", False)]
    df = spark.createDataFrame([(k, n, *at(s), outcome, permanent) for k, n, s, outcome, permanent in rows], TABLE)
    job = lambda now: {x.user_id: tuple(x)[1:] for x in jobs.run_jobs(df, "user_id", str(at(now)[0])).collect()}
    assert job(20) == {1: (2, "retrying", 1, 0), 2: (3, "cancelled", 1, 0), 3: (0, "queued", 0, 0)}  # the first event of 3 hasn't come
    assert job(26) == {1: (2, "queued", 1, 1), 2: (3, "cancelled", 1, 0), 3: (0, "queued", 0, 0)}


def log_of(spark, folder):
    schema = spark.createDataFrame([], "k string, at long, message string").schema
    return jobs.NumberedLog(spark, f"{folder}/log", schema, "k", ["at"], F.col("message") != "")


def rows_of(log, name="events"):
    return sorted((tuple(x) for x in log.read(name).collect()), key=str)


def test_numbers_go_on_and_batches_run_twice(spark, tmp_path):
    schema = "k string, at long, message string"
    log, source = log_of(spark, tmp_path), f"{tmp_path}/source"
    spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 1, "z"), ("a", 2, ""), (None, 7, "n"), ("a", 9, None)], schema).write.mode("append").parquet(source)
    log.append(source)
    first = [(1, "a", 1, "y"), (1, "b", 1, "z"), (1, None, 7, "n"), (2, "a", 3, "x")]
    assert rows_of(log) == sorted(first, key=str) and {x[2] for x in log.read("refused").collect()} == {"", None}
    log.append(source)  # nothing new
    log_of(spark, tmp_path).append(source)  # nor for another writer
    assert rows_of(log) == sorted(first, key=str)
    spark.createDataFrame([("a", 0, "late"), ("c", 0, "c"), (None, 8, "n")], schema).write.mode("append").parquet(source)
    log.append(source)
    both = sorted([*first, (3, "a", 0, "late"), (1, "c", 0, "c"), (2, None, 8, "n")], key=str)
    assert rows_of(log) == both
    last = log.read().filter("k = 'a' and seq = 3 or k = 'c' or k is null and seq = 2")
    number = max(int(p.name.split("=")[1]) for p in (tmp_path / "log/events").iterdir() if "=" in p.name)
    again = spark.createDataFrame(last.collect(), last.schema)
    jobs.write_batch(again, f"{tmp_path}/log/events", number)
    assert rows_of(log) == both


def test_what_is_left_of_logs_that_grow_one_by_one(spark):
    def left(n, most, kept):
        log = []
        for k in range(1, n + 1):
            log.append(k)
            if len(log) > most:
                log = [log[0], *log[-(kept - 1) :]]
        return log

    sizes = [1, 9, 10, 11, 12, 14, 15, 16, 31, 100]
    df = spark.createDataFrame([(f"k{n}" if n > 1 else None, s) for n in sizes for s in range(1, n + 1)], "k string, seq long")
    got = defaultdict(list)
    for r in events.retain_one_by_one(df, "k", 10, 7).collect():
        got[r.k].append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {f"k{n}" if n > 1 else None: left(n, 10, 7) for n in sizes}
