"""Queries that have no SQL for the whole of their input, or whose SQL a single small table doesn't put to the test."""

import os
import re
from datetime import datetime, timedelta
from unicodedata import normalize

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from parchment import queries as engine
from parchment.operators import machines
from parchment.plans import base
from parchment.streaming import logs


def test_whole_texts_are_normalised(spark, tmp_path):
    texts = ["a " * 60 + "\ufb01n \uff21\u3000\u3000e\u0301 \u2460", "\u00a0\u2003x" + "\ufb03" * 300, "", None, "line\n\n" * 40 + "\uff76\uff9e"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.plain for r in engine.queries()["nfkc_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else re.sub(r"\s+", " ", normalize("NFKC", t)) for i, t in enumerate(texts)}


def log_of_many_files(spark, path, span_days):
    """Events in 200 files, which is more than three triggers take; the oldest file has the last events."""
    kinds = ["view", "error", "click", "signup", "error", "purchase", "view"]
    n = 200
    rows = [(i, i % 3, datetime(2024, 1, 1) + timedelta(days=span_days * i / n), kinds[i * 5 % 7], float(i * 37 % 100), "{}") for i in range(n)]
    all_of = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").toArrow()
    (path / "events.parquet").mkdir()
    for k in range(200):
        file = path / "events.parquet" / f"part-{k:05}.parquet"
        pq.write_table(all_of.slice(k, 1), file)
        os.utime(file, (1_700_000_000 - k * 60,) * 2)
    return rows


def test_streams_take_events_in_order_whatever_their_files(spark, tmp_path):
    log_of_many_files(spark, tmp_path, 400)
    e = engine.queries()["job_lifecycle"](spark, str(tmp_path)).toPandas().sort_values("seq")
    want = {r.user_id: (r.seq, r.status, r.attempts) for r in e.itertuples()}
    got = {r.user_id: (r.seq, r.status, r.attempts) for r in engine.queries()["stream_lifecycle"](spark, str(tmp_path)).collect()}
    assert got == want


def test_no_event_is_late_whatever_their_files(spark, tmp_path):
    rows = log_of_many_files(spark, tmp_path, 400)
    once = {r.user_id: (r.n, r.last_seq) for r in engine.queries()["stream_once"](spark, str(tmp_path)).collect()}
    assert once == {u: (sum(r[1] == u for r in rows), max(r[0] for r in rows if r[1] == u)) for u in range(3)}


def test_ranges_of_a_log_follow_one_another(spark, tmp_path):
    log_of_many_files(spark, tmp_path, 400)
    e = base.table(spark, str(tmp_path), "events").withColumn("ts", F.col("ts").cast("timestamp"))
    once = lambda rows: logs.once(rows, ["user_id", "event_id"]).select("user_id", "event_id", "value")
    assert logs.collect_in_order(e, F.unix_micros("ts"), once, ["user_id", "event_id"], "value", rows=50).count() == 200
    jobs = e.select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") * 1000).alias("t_ms"), F.when(F.col("event_id") % 4 == 0, "error").otherwise("start").alias("outcome"), (F.col("value") > 60).alias("permanent"))
    got = {r.user_id: (r.seq, r.status, r.attempts) for r in logs.collect_in_order(jobs, F.col("seq"), logs.lifecycle, ["user_id"], "seq", "update", rows=50).collect()}
    want = machines.job_lifecycle(jobs, "user_id", ["seq"]).orderBy("seq").collect()
    assert got == {r.user_id: (r.seq, r.status, r.attempts) for r in want}
