"""Named queries over event logs and state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import numbers
from parchment.operators import events, machines
from parchment.plans.base import LOGS, logs, table

_E = ["user_id", "seq", "event_type", "value"]


def event_tail(spark, d):
    return events.tail(logs(spark, d), "user_id", 5).select(*_E)


def event_after_cursor(spark, d):
    return events.after(logs(spark, d), "user_id", 1000, 3).select(*_E)


def event_last_seq(spark, d):
    return events.last_seq(logs(spark, d), "user_id")


def event_retention(spark, d):
    return events.retain(logs(spark, d), "user_id", 50, 40).select(*_E)


def event_merge(spark, d):
    e = logs(spark, d)
    pushed = e.filter(F.col("seq") % 3 == 0).withColumn("value", F.col("value") + 1)
    return events.merge(e.filter(F.col("seq") % 2 == 0), pushed, "user_id", 20).select(*_E)


def event_numbers(spark, d):
    return events.number(logs(spark, d).withColumnRenamed("seq", "event_id"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


def latest_event(spark, d):
    return events.latest(logs(spark, d), "user_id", ["event_type", "value"])


def event_gaps(spark, d):
    e = logs(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return events.gaps(e, "user_id", "us", ["seq"]).select("seq", "gap")


def row_offsets(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("h"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "h"]
    tops = events.offsets(li, "l_orderkey", "h", order)
    return events.in_view(tops, "h", 40, 60, overscan=10).select("l_orderkey", "l_linenumber", "h", "top")


def peak_in_flight(spark, d):
    e = logs(spark, d).select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.unix_millis(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1_000_000)).alias("upto"))
    return events.peak_in_flight(e, "user_id", "at", "upto")


def mean_progress(spark, d):
    return logs(spark, d).groupBy("event_type").agg(F.round(numbers.mean_progress(F.col("value")), 9).alias("progress"))


def status_throttle(spark, d):
    """The latest event of each user in each stretch of ten hours (ten thousandths of a second make one in real logs)."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 36_000)
    e = logs(spark, d).withColumn("slot", slot)
    return e.groupBy("user_id", "slot").agg(F.max_by("event_type", "seq").alias("event_type"), F.max("seq").alias("seq"))


def event_windows(spark, d):
    """Events by type and hour, and how many users they come from."""
    e = logs(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "users")


def event_sessions(spark, d):
    """Stretches of a user's events with less than six hours between them."""
    e = logs(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return e.select("user_id", F.col("w.start").alias("start"), "n", "first_seq")


def _outcomes(spark, d):
    return logs(spark, d).select("user_id", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), "event_type", "value")


def aimd_trace(spark, d):
    """Errors as rate limits, at a ten-thousandth of the pace."""
    e = _outcomes(spark, d).withColumns({"outcome": F.when(F.col("event_type") == "error", "rate_limited").otherwise("ok"), "t_ms": F.floor(F.col("t_ms") / 10_000)})
    return machines.concurrency(e, "user_id", ["seq"], 32)


def key_ring(spark, d):
    e = _outcomes(spark, d).withColumn("outcome", F.when(F.col("event_type") == "error", "credential").otherwise("ok"))
    return machines.key_ring(e, "user_id", ["seq"], 3)


def retry_ladder(spark, d):
    kind = F.when(F.col("event_type").isin("error", "view"), "transient").when(F.col("event_type") == "signup", "rejected")
    e = _outcomes(spark, d).select("user_id", "seq", kind.alias("kind"), F.when(F.col("value") > 50, F.floor(F.col("value")) * 100).cast("double").alias("retry_after_ms"))
    return machines.retry_ladder(e, "user_id", ["seq"])


def job_outcome():
    """What an event means to a job; clicks of small value cancel it."""
    names = {"view": "start", "click": "start", "error": "error", "purchase": "done", "signup": "recover"}
    outcome = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return F.when((F.col("event_type") == "click") & (F.col("value") < 20), "cancel").otherwise(outcome)


def job_lifecycle(spark, d):
    e = _outcomes(spark, d).select("user_id", "seq", "t_ms", job_outcome().alias("outcome"), (F.col("value") > 60).alias("permanent"))
    return machines.job_lifecycle(e, "user_id", ["seq"])


_TAIL = "row_number() OVER (PARTITION BY user_id ORDER BY seq DESC)"
_NUMBERED = "n AS (SELECT user_id, event_id AS seq, event_type, value, epoch_ms(ts) AS t_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"

QUERIES = {
    "event_tail": (event_tail, f"WITH {LOGS} SELECT user_id, seq, event_type, value FROM l QUALIFY {_TAIL} <= 5"),
    "event_after_cursor": (event_after_cursor, f"WITH {LOGS} SELECT user_id, seq, event_type, value FROM l WHERE seq > 1000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 3"),
    "event_last_seq": (event_last_seq, f"WITH {LOGS} SELECT user_id, max(seq) AS last_seq FROM l GROUP BY user_id"),
    "event_retention": (event_retention, f"WITH {LOGS} SELECT user_id, seq, event_type, value FROM l QUALIFY count(*) OVER (PARTITION BY user_id) <= 50 OR row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1 OR {_TAIL} <= 39"),
    "event_merge": (event_merge, f"WITH {LOGS}, u AS (SELECT user_id, seq, event_type, CASE WHEN seq % 3 = 0 THEN value + 1 ELSE value END AS value FROM l WHERE seq % 2 = 0 OR seq % 3 = 0) SELECT * FROM u QUALIFY {_TAIL} <= 20"),
    "event_numbers": (event_numbers, "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"),
    "latest_event": (latest_event, f"WITH {LOGS} SELECT user_id, seq, event_type, value FROM l QUALIFY {_TAIL} = 1"),
    "event_gaps": (event_gaps, f"WITH {LOGS} SELECT seq, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY seq)) - epoch_us(ts) AS gap FROM l"),
    "row_offsets": (row_offsets, "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS h, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS top FROM lineitem) SELECT * FROM t WHERE top + h > 30 AND top < 70"),
    "peak_in_flight": (peak_in_flight, "WITH s AS (SELECT user_id, epoch_ms(ts) AS a, epoch_ms(ts) + floor(value * 1000000)::BIGINT AS b FROM events), e AS (SELECT user_id, a AS at_ms, 1 AS d FROM s UNION ALL SELECT user_id, b, -1 FROM s), o AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY at_ms, d ROWS UNBOUNDED PRECEDING) AS open FROM e) SELECT user_id, max(open)::BIGINT AS peak FROM o GROUP BY user_id"),
    "mean_progress": (mean_progress, "SELECT event_type, round(coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, avg(value) / 100)), -1.0::DOUBLE), 9) AS progress FROM events GROUP BY event_type"),
    "status_throttle": (status_throttle, "SELECT user_id, (epoch(ts)::BIGINT // 36000) AS slot, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM (SELECT user_id, event_id, event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY ALL"),
    "event_windows": (event_windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"),
    "event_sessions": (event_sessions, "WITH g AS (SELECT *, coalesce((ts >= lag(ts) OVER w + INTERVAL 6 HOURS)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, min(event_id) AS first_seq FROM s GROUP BY user_id, k"),
    "aimd_trace": (aimd_trace, f"""
WITH RECURSIVE {_NUMBERED}, f AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS seq, 32::BIGINT AS current, 0::BIGINT AS good, NULL::BIGINT AS cut FROM n GROUP BY user_id
  UNION ALL
  SELECT user_id, i, seq, CASE WHEN is_cut THEN greatest(1, current // 2) WHEN grows THEN least(32, current + greatest(1, current // 4)) ELSE current END,
    CASE WHEN is_cut OR grows OR (ok AND current >= 32) THEN 0 WHEN ok THEN good + 1 ELSE good END, CASE WHEN is_cut THEN t ELSE cut END
  FROM (SELECT n.user_id, n.i, n.seq, f.current, f.good, f.cut, n.t_ms // 10000 AS t, n.event_type <> 'error' AS ok,
      n.event_type = 'error' AND (f.cut IS NULL OR n.t_ms // 10000 - f.cut >= 10000) AS is_cut, n.event_type <> 'error' AND f.current < 32 AND f.good + 1 >= greatest(f.current, 4) AS grows
    FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
) SELECT user_id, seq, current FROM f WHERE i > 0"""),
    "key_ring": (key_ring, f"""
WITH RECURSIVE {_NUMBERED}, f AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS picked, 0::BIGINT AS next, [0, 0, 0]::BIGINT[] AS rests FROM n GROUP BY user_id
  UNION ALL
  SELECT user_id, i, seq, picked, CASE WHEN picked < 0 THEN next ELSE next % len(usable) + 1 END,
    CASE WHEN err AND picked >= 0 THEN list_transform([0, 1, 2], lambda k: CASE WHEN k = picked THEN t_ms + 600000 ELSE rests[k + 1] END) ELSE rests END
  FROM (SELECT *, CASE WHEN len(usable) = 0 THEN -1 ELSE usable[next % len(usable) + 1] END::BIGINT AS picked FROM (
    SELECT n.user_id, n.i, n.seq, f.next, f.rests, n.t_ms, n.event_type = 'error' AS err, list_filter([0, 1, 2], lambda k: f.rests[k + 1] <= n.t_ms) AS usable
    FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1))
) SELECT user_id, seq, picked FROM f WHERE i > 0"""),
    "retry_ladder": (retry_ladder, f"""
WITH RECURSIVE {_NUMBERED}, f AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS decision, NULL::DOUBLE AS wait_ms, 0::BIGINT AS attempt, 0::BIGINT AS rejected, false AS over FROM n GROUP BY user_id
  UNION ALL
  SELECT user_id, i, seq,
    CASE WHEN over THEN 'skipped' WHEN ok THEN 'done' WHEN rej THEN CASE WHEN rejected + 1 >= 6 THEN 'document ends' ELSE 'given up' END WHEN attempt + 1 >= 8 THEN 'document ends' ELSE 'retry' END,
    CASE WHEN NOT over AND NOT ok AND NOT rej AND attempt + 1 < 8 THEN greatest(coalesce(asked, base), base / 2) END,
    CASE WHEN over THEN attempt WHEN ok OR rej THEN 0 ELSE attempt + 1 END, CASE WHEN over THEN rejected WHEN ok THEN 0 WHEN rej THEN rejected + 1 ELSE rejected END,
    over OR (rej AND rejected + 1 >= 6) OR (NOT ok AND NOT rej AND attempt + 1 >= 8)
  FROM (SELECT n.user_id, n.i, n.seq, f.attempt, f.rejected, f.over, n.event_type NOT IN ('error', 'view', 'signup') AS ok, n.event_type = 'signup' AS rej,
      CASE WHEN n.value > 50 THEN floor(n.value) * 100 END AS asked, least(pow(2, f.attempt), 32.0::DOUBLE) * 1000 AS base
    FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
) SELECT user_id, seq, decision, wait_ms FROM f WHERE i > 0"""),
    "job_lifecycle": (job_lifecycle, f"""
WITH RECURSIVE {_NUMBERED}, f AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS seq, 'queued' AS status, 0::BIGINT AS attempts, 0::BIGINT AS due FROM n GROUP BY user_id
  UNION ALL
  SELECT user_id, i, seq,
    CASE WHEN event_type = 'click' AND value < 20 THEN CASE WHEN status IN ('queued', 'processing', 'retrying') THEN 'cancelled' ELSE status END WHEN event_type IN ('view', 'click') AND (status = 'queued' OR (status = 'retrying' AND due <= t_ms)) THEN 'processing' WHEN event_type = 'purchase' AND status IN ('processing', 'cancelled') THEN 'completed'
      WHEN event_type = 'signup' AND status IN ('processing', 'retrying') THEN 'queued' WHEN event_type = 'error' AND status = 'processing' THEN CASE WHEN value <= 60 AND attempts + 1 < 3 THEN 'retrying' ELSE 'failed' END ELSE status END,
    CASE WHEN event_type = 'error' AND status = 'processing' THEN attempts + 1 ELSE attempts END,
    CASE WHEN event_type = 'error' AND status = 'processing' THEN CASE WHEN value <= 60 AND attempts + 1 < 3 THEN t_ms + 20000 * (attempts + 1) ELSE 0 END ELSE due END
  FROM (SELECT n.user_id, n.i, n.seq, n.event_type, n.value, n.t_ms, f.status, f.attempts, f.due FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
) SELECT user_id, seq, status, attempts FROM f WHERE i > 0"""),
}
