"""How the given tables stand for documents, events, pages and so on; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that queries take as now.
NOW = "2024-02-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a library has them: the length of the text stands for status, stage and time."""
    n = F.col("n_chars")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.concat("lang", F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        pick(["queued", "processing", "retrying", "completed", "failed", "cancelled", "completed"]).alias("status"), pick(["received", "inspect", "analyze", "translate", "compose", "verify", "archive", "done"]).alias("stage"),
        F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("created_at"),
        F.when(n % 3 > 0, F.timestamp_seconds(F.lit(1704067260) + n * 61)).alias("started_at"), F.when(n % 2 > 0, F.timestamp_seconds(F.lit(1704067260) + n * 62)).alias("completed_at"),
        F.timestamp_seconds(F.lit(1704067260) + n * 63).alias("updated_at"), F.when(n % 4 > 1, F.timestamp_seconds(F.lit(1706000000) + n * 60)).alias("next_attempt_at"),
    )


MANIFESTS = """
m AS (SELECT doc_id AS id, source AS title, lang || doc_id || '.pdf' AS filename,
  (['queued', 'processing', 'retrying', 'completed', 'failed', 'cancelled', 'completed'])[n_chars % 7 + 1] AS status,
  (['received', 'inspect', 'analyze', 'translate', 'compose', 'verify', 'archive', 'done'])[n_chars % 8 + 1] AS stage,
  to_timestamp(1704067200 + n_chars * 60) AS created_at,
  CASE WHEN n_chars % 3 > 0 THEN to_timestamp(1704067260 + n_chars * 61) END AS started_at, CASE WHEN n_chars % 2 > 0 THEN to_timestamp(1704067260 + n_chars * 62) END AS completed_at,
  to_timestamp(1704067260 + n_chars * 63) AS updated_at, CASE WHEN n_chars % 4 > 1 THEN to_timestamp(1706000000 + n_chars * 60) END AS next_attempt_at
  FROM documents),
b AS (SELECT *, CASE WHEN status = 'completed' THEN 'completed' WHEN status IN ('failed', 'cancelled') THEN 'failed' ELSE 'active' END AS bucket FROM m)
"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the logs of documents: a user is a document, and event_id the sequence."""
    return table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("seq"), "ts", "event_type", "value", "props")


LOGS = "l AS (SELECT user_id, event_id AS seq, ts, event_type, value, props FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and replies: a user's turn, and the assistant's that comes next."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    both = table(spark, sf_dir, "conversations").withColumns({"reply": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return both.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("input"), "reply")


TURNS = """
t AS (SELECT conv_id, turn, text AS input, reply FROM (
  SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
) WHERE role = 'user' AND next_role = 'assistant')
"""

#: Whitespace of text functions, as DuckDB's regular expressions write it.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_words(x: str) -> str:
    """The number of words."""
    return f"len(regexp_extract_all({x}, '\\S+'))::BIGINT"
