"""Named queries that go through files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.operators import events
from parchment.plans.base import NOW, table
from parchment.plans.base import logs as event_logs
from parchment.plans.events import QUERIES as EVENTS
from parchment.plans.events import job_outcome
from parchment.sources import library
from parchment.sources.scratch import scratch_path
from parchment.streaming import jobs, logs


def _lines(spark, d):
    """Events as lines of JSON; some broken, some blank, some that break a rule."""
    e = table(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    made = F.to_json(F.struct((F.col("event_id") + 1).alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.lit("translate").alias("stage"), level.alias("level"), (F.col("value") * 3).alias("progress"), F.col("event_type").alias("message")))
    k = F.col("event_id") % 10
    return e.select(F.col("user_id").cast("string").alias("doc_id"), F.when(k == 0, F.left(made, F.lit(20))).when(k == 1, "  ").otherwise(made).alias("value"))


def events_jsonl_scan(spark, d):
    """The lines go through files of JSON, each beside its document, so there are as many files as tasks write."""
    path = scratch_path(spark, "logs")
    _lines(spark, d).write.json(path)
    return library.parse_events(spark.read.schema("doc_id string, value string").json(path))[0].select("doc_id", "seq", "level", "progress", "message")


def events_jsonl_broken(spark, d):
    return library.parse_events(_lines(spark, d))[1].groupBy("doc_id").agg(F.count("*").alias("n"))


def manifest_scan(spark, d):
    """Manifests as JSON files, of which some are cut off."""
    n = F.col("n_chars")
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.lit("queued").alias("status"), (n % 120).cast("double").alias("progress"), F.struct(F.col("lang").alias("model")).alias("translator")))
    files = table(spark, d, "documents").select(F.when(n % 9 == 0, F.left(whole, F.lit(30))).otherwise(whole).alias("value"))
    return library.parse_manifests(files)[0].select("id", "title", "progress", F.col("translator.model").alias("model"))


def glossary_csv_roundtrip(spark, d):
    """Part names as glossaries by type, with quotes and commas in them, written as CSV and read again."""
    parts = table(spark, d, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("ord"), F.min("p_brand").alias("brand"))
    entries = parts.select("p_type", "ord", F.concat("p_name", F.lit(' "x", y')).alias("source"), F.col("brand").alias("target"), F.when(F.col("ord") % 3 == 0, "zh-CN").when(F.col("ord") % 3 == 1, "fr").alias("tgt_lng"))
    path = scratch_path(spark, "glossary")
    library.glossary_csv(entries, ["p_type"]).select(F.regexp_replace("csv", "\r\n$", "").alias("csv"), "p_type").repartition("p_type").write.partitionBy("p_type").text(path)
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).schema("source string, target string, tgt_lng string, p_type string").csv(path)
    return library.for_language(rows, "zh_cn").select("p_type", "source", "target")


def glossary_decode(spark, d):
    """Pages as files: half in UTF-8 with a mark, half in GB18030."""
    even = F.encode(F.concat(F.lit("\ufeff"), F.coalesce("html", F.lit(""))), "utf-8")
    odd = F.concat(F.unhex(F.lit("D6D0CEC4")), F.encode(F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x00-\x7F]", "?"), "utf-8"))
    return library.decode_csv(table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, even).otherwise(odd).alias("content"))).select("page_id", "text")


def file_intake(spark, d):
    files = table(spark, d, "pages").select("page_id", F.concat(F.col("url"), F.when(F.col("page_id") % 4 > 0, ".PDF").otherwise(".txt")).alias("path"), (F.octet_length("html") * F.pmod("page_id", F.lit(5)) * 30_000).alias("length"))
    return library.intake(files).select("page_id", "refused")


def stream_once(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = lambda rows: rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = lambda rows: logs.once(doubled(rows), ["user_id", "event_id"]).select("user_id", "event_id", "value")
    return logs.collect_in_order(e, F.unix_micros("ts"), once, ["user_id", "event_id"], "value").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_seq"))


def stream_throttle(spark, d):
    e = logs.read_stream(spark, f"{d}/events.parquet")
    out = logs.throttled(e, "user_id", "event_id", "10 hours", ["event_type"])
    return logs.collect_stream(out, ["user_id", "slot"], "event_id", "update").select("user_id", F.col("slot").cast("timestamp_ntz").alias("slot"), "event_id", "event_type")


def stream_lifecycle(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("user_id", F.col("event_id").alias("seq"), F.unix_millis("ts").alias("t_ms"), job_outcome().alias("outcome"), (F.col("value") > 60).alias("permanent"))
    return logs.collect_in_order(e, F.col("seq"), logs.lifecycle, ["user_id"], "seq", "update")


def _job_events(spark, d):
    e = event_logs(spark, d).withColumnRenamed("seq", "event_id")
    ts = F.col("ts").cast("timestamp")
    return events.number(e, "user_id", ["event_id"]).select("user_id", F.col("seq").alias("n"), ts.alias("ts"), F.unix_millis(ts).alias("t_ms"), job_outcome().alias("outcome"), (F.col("value") > 60).alias("permanent"))


def stream_job_timers(spark, d):
    """Jobs at the moment that queries take as now. The log's files have events in no order; retries come due by timers."""
    return jobs.run_jobs(_job_events(spark, d).repartition(8, F.xxhash64("t_ms", "user_id")), "user_id", NOW)


def _append(spark, d):
    """A log of the events of even number, to which the others are then added; values under 5 break the rules."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    source = scratch_path(spark, "events")
    log = jobs.NumberedLog(spark, scratch_path(spark, "numbered-log"), e.schema, "user_id", ["event_id"], F.col("value") >= 5)
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        log.append(source, files_per_trigger=1 << 20)
    return log


def event_append(spark, d):
    return events.retain_one_by_one(_append(spark, d).read(), "user_id", 50, 40).select("user_id", "seq", "event_id", "event_type")


def event_refused(spark, d):
    return _append(spark, d).read("refused").select("user_id", "event_id", "value")


_TIMERS = f"""
WITH RECURSIVE n AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, epoch_ms(ts) AS t_ms, value > 60 AS permanent,
    CASE WHEN event_type = 'click' AND value < 20 THEN 'cancel' WHEN event_type IN ('view', 'click') THEN 'start' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'signup' THEN 'recover' ELSE event_type END AS outcome
  FROM events
), f AS (
  SELECT user_id, 0::BIGINT AS i, 'queued' AS status, 0::BIGINT AS attempts, 0::BIGINT AS due, 0::BIGINT AS resumed FROM n GROUP BY user_id
  UNION ALL
  SELECT user_id, i,
    CASE WHEN outcome = 'cancel' AND was IN ('queued', 'processing', 'retrying') THEN 'cancelled' WHEN outcome = 'start' AND was = 'queued' THEN 'processing' WHEN outcome = 'done' AND was IN ('processing', 'cancelled') THEN 'completed'
      WHEN outcome = 'recover' AND was IN ('processing', 'retrying') THEN 'queued' WHEN failed THEN CASE WHEN again THEN 'retrying' ELSE 'failed' END ELSE was END,
    attempts + failed::INT, CASE WHEN failed AND again THEN t_ms + 20000 * (attempts + 1) ELSE due END, resumed
  FROM (
    SELECT *, outcome = 'error' AND was = 'processing' AS failed, NOT permanent AND attempts + 1 < 3 AS again FROM (
      SELECT n.user_id, n.i, n.t_ms, n.permanent, n.outcome, f.attempts, f.due, CASE WHEN f.status = 'retrying' AND f.due <= n.t_ms THEN 'queued' ELSE f.status END AS was, f.resumed + (f.status = 'retrying' AND f.due <= n.t_ms)::INT AS resumed
      FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1
    )
  )
) SELECT user_id, i AS seq, CASE WHEN late THEN 'queued' ELSE status END AS status, attempts, resumed + late::INT AS resumed
FROM (SELECT *, status = 'retrying' AND due < epoch_ms(TIMESTAMP '{NOW}') AS late FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)"""

QUERIES = {
    "events_jsonl_scan": (events_jsonl_scan, "SELECT user_id::VARCHAR AS doc_id, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, value * 3 AS progress, event_type AS message FROM events WHERE event_id % 10 > 1 AND value * 3 BETWEEN 0 AND 100"),
    "events_jsonl_broken": (events_jsonl_broken, "SELECT user_id::VARCHAR AS doc_id, count(*) AS n FROM events WHERE event_id % 10 = 0 OR (event_id % 10 > 1 AND value * 3 > 100) GROUP BY user_id"),
    "manifest_scan": (manifest_scan, "SELECT doc_id::VARCHAR AS id, source AS title, (n_chars % 120)::DOUBLE AS progress, lang AS model FROM documents WHERE n_chars % 9 > 0 AND n_chars % 120 <= 100"),
    "glossary_csv_roundtrip": (glossary_csv_roundtrip, "SELECT p_type, p_name || ' \"x\", y' AS source, min(p_brand) AS target FROM part GROUP BY p_type, p_name HAVING min(p_partkey) % 3 <> 1"),
    "glossary_decode": (glossary_decode, r"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN coalesce(html, '') ELSE '中文' || regexp_replace(coalesce(html, ''), '[^\x00-\x7F]', '?', 'g') END AS text FROM pages"),
    "file_intake": (file_intake, "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'empty' WHEN strlen(html) * (page_id % 5) * 30000 > 524288000 THEN 'too large' WHEN page_id % 4 = 0 THEN 'not a PDF' END AS refused FROM pages"),
    "stream_once": (stream_once, "SELECT user_id, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY user_id"),
    "stream_throttle": (stream_throttle, "SELECT user_id, time_bucket(INTERVAL 10 HOURS, ts, TIMESTAMP '1970-01-01') AS slot, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL"),
    "stream_lifecycle": (stream_lifecycle, f"SELECT user_id, seq, status, attempts FROM ({EVENTS['job_lifecycle'][1]}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1"),
    "stream_job_timers": (stream_job_timers, _TIMERS),
    "event_append": (event_append, """
WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value >= 5),
b AS (SELECT *, CASE WHEN n <= 50 THEN n ELSE 40 + (n - 51) % 11 END AS left_over FROM a)
SELECT user_id, seq, event_id, event_type FROM b WHERE seq = 1 OR seq > n - left_over + 1"""),
    "event_refused": (event_refused, "SELECT user_id, event_id, value FROM events WHERE value < 5 OR value IS NULL"),
}
