"""Named queries over the library of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import numbers, predicates, text
from parchment.operators import catalog
from parchment.plans.base import MANIFESTS, NOW, manifests, table

_SHOWN = ["id", "title", "filename", "status", "created_at"]
_NOW = f"TIMESTAMPTZ '{NOW}+00'"


def catalog_list(spark, d):
    return catalog.list_documents(manifests(spark, d), "active", "SRC1 en").select(*_SHOWN)


def catalog_counts(spark, d):
    return catalog.count_documents(manifests(spark, d), "src1")


def catalog_recount(spark, d):
    return manifests(spark, d).groupBy(predicates.status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))


def catalog_get(spark, d):
    """Every document's summary, as one asks for by id."""
    s = catalog.summary(manifests(spark, d))
    return s.select("id", "title", F.col("names.mono").alias("mono"), F.col("names.dual").alias("dual"), F.col("names.bundle").alias("bundle"), F.col("names.glossary").alias("glossary"), F.col("names.source").alias("source"))


def queue_order(spark, d):
    q = catalog.queue(manifests(spark, d))
    return q.select("id", F.coalesce("next_attempt_at", "created_at").alias("turn_at"))


def queue_dequeue(spark, d):
    return catalog.queue(manifests(spark, d), free=4).select("id")


def cancellable(spark, d):
    return catalog.cancellable(manifests(spark, d)).select("id", "status", "stage")


def neighbor(spark, d):
    return catalog.neighbours(manifests(spark, d), ["title"]).select("id", "next_id")


def step_clamped(spark, d):
    return catalog.step(manifests(spark, d), ["title"], 5).select("id", "step_id")


def stage_states(spark, d):
    return manifests(spark, d).select("id", *[predicates.stage_state(F.col("status"), F.col("stage"), s).alias(s) for s in predicates.STAGES])


def elapsed_times(spark, d):
    ms = numbers.elapsed_ms(F.col("status"), F.col("started_at"), F.col("completed_at"), F.col("updated_at"), F.lit(NOW).cast("timestamp"))
    return manifests(spark, d).select("id", ms.alias("elapsed_ms"), numbers.format_elapsed(ms).alias("elapsed"))


def relative_times(spark, d):
    at = F.col("updated_at") + F.expr("INTERVAL 28 DAYS")
    return manifests(spark, d).select("id", numbers.relative_time(at, F.lit(NOW).cast("timestamp")).alias("told"))


def promote_due(spark, d):
    import datetime

    now = datetime.datetime(2024, 2, 1, 12, tzinfo=datetime.UTC)
    return catalog.promote_due(manifests(spark, d), now).select("id", "status")


def recover_after_crash(spark, d):
    return catalog.recover(manifests(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def compare_and_set(spark, d):
    docs = manifests(spark, d)
    changes = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("processing").alias("expected"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return catalog.update_when(docs, changes, ["status"]).select("id", "status", "changed")


def enabled_translators(spark, d):
    """Customers as providers: with a balance they have a key, and market segments are their models."""
    p = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("models"), F.sum("c_acctbal").alias("balance"))
    p = p.select(F.col("c_nationkey").alias("provider_id"), "models", (F.col("c_nationkey") % 2 == 0).alias("enabled"), (F.col("balance") > 0).alias("has_key"), (F.col("c_nationkey") % 3 == 0).alias("key_optional"))
    return catalog.enabled_translators(p)


def filename_sanitize(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", text.sanitize_filename(F.col("url")).alias("name"), text.basename(F.col("url")).alias("base"), text.file_stem(F.concat("url", F.lit(".PDF"))).alias("stem"))


def unique_names(spark, d):
    return catalog.unique_names(table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", F.col("unique").alias("name"))


def document_ids(spark, d):
    return manifests(spark, d).select("id", text.document_id(F.col("created_at"), F.left(F.sha2(F.encode("title", "utf-8"), 256), F.lit(6))).alias("name"))


def size_format(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", numbers.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"), numbers.format_bytes(F.col("n_chars")).alias("small"))


def version_compare(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("a"), F.concat(F.lit("v"), F.concat_ws("-", F.pmod("l_partkey", F.lit(7)).cast("string"), F.pmod("l_suppkey", F.lit(50)).cast("string"), F.lit("rc"))).alias("b"))
    return li.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("newer", predicates.version_newer(F.col("a"), F.col("b")))


def permanent_errors(spark, d):
    codes = ["pdf_encrypted", "verify_failed", "not_found", "internal", "page_geometry", "worker_crashed", "cancelled"]
    code = F.element_at(F.array(*map(F.lit, codes)), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", code.alias("code"))
    return o.withColumn("permanent", predicates.is_permanent(F.col("code")))


_ORDER = "OVER (PARTITION BY title ORDER BY created_at DESC, id DESC)"
_STAGE = "list_position(['received', 'inspect', 'analyze', 'translate', 'compose', 'verify', 'archive'], stage)"
_MS = f"CASE WHEN started_at IS NOT NULL THEN greatest(0, epoch_ms(CASE WHEN bucket = 'active' THEN {_NOW} ELSE coalesce(completed_at, updated_at) END) - epoch_ms(started_at)) END"


def _bytes(n: str) -> str:
    """Halves go up, as in toFixed(): printf alone would round 2.25 to the even 2.2."""
    return f"""CASE WHEN {n} <= 0 THEN '0 KB' WHEN floor({n} / 1024 + 0.5) < 1024 THEN greatest(1, floor({n} / 1024 + 0.5)::BIGINT) || ' KB'
      WHEN round({n} / 1024 / 1024, 1) < 1024 THEN printf('%.1f', floor({n} / 1024 / 1024 * 10 + 0.5) / 10) || ' MB' ELSE printf('%.2f', floor({n} / 1024 / 1024 / 1024 * 100 + 0.5) / 100) || ' GB' END"""


_NUMS = lambda c: f"list_transform(string_split_regex(regexp_replace({c}, '^v', ''), '[.-]'), lambda p: coalesce(try_cast(p AS INT), 0))"
_CLEAN = r"""regexp_replace(regexp_replace(url, '[\x00-\x1F\\/:*?"<>|]', '_', 'g'), '^[\s.]+|[\s.]+$', '', 'g')"""

QUERIES = {
    "catalog_list": (catalog_list, f"WITH {MANIFESTS} SELECT id, title, filename, status, created_at FROM b WHERE bucket = 'active' AND contains(lower(title || chr(10) || filename), 'src1') AND contains(lower(title || chr(10) || filename), 'en') ORDER BY created_at DESC, id DESC"),
    "catalog_counts": (catalog_counts, f"WITH {MANIFESTS} SELECT count(*) AS \"all\", count_if(bucket = 'active')::BIGINT AS active, count_if(bucket = 'completed')::BIGINT AS completed, count_if(bucket = 'failed')::BIGINT AS failed FROM b WHERE contains(lower(title || chr(10) || filename), 'src1')"),
    "catalog_recount": (catalog_recount, f"WITH {MANIFESTS} SELECT bucket, count(*) AS n FROM b GROUP BY bucket"),
    "catalog_get": (catalog_get, f"WITH {MANIFESTS} SELECT id, title, title || '-中文译文.pdf' AS mono, title || '-双语对照.pdf' AS dual, title || '-完整文件.zip' AS bundle, title || '-术语表.csv' AS glossary, filename AS source FROM m"),
    "queue_order": (queue_order, f"WITH {MANIFESTS} SELECT id, coalesce(next_attempt_at, created_at) AS turn_at FROM m WHERE status = 'queued'"),
    "queue_dequeue": (queue_dequeue, f"WITH {MANIFESTS} SELECT id FROM m WHERE status = 'queued' ORDER BY coalesce(next_attempt_at, created_at), id LIMIT 4"),
    "cancellable": (cancellable, f"WITH {MANIFESTS} SELECT id, status, stage FROM b WHERE bucket = 'active' AND NOT (status = 'processing' AND stage = 'archive')"),
    "neighbor": (neighbor, f"WITH {MANIFESTS} SELECT id, coalesce(lead(id) {_ORDER}, lag(id) {_ORDER}) AS next_id FROM m"),
    "step_clamped": (step_clamped, f"WITH {MANIFESTS}, n AS (SELECT id, title, row_number() {_ORDER} AS at_row, count(*) OVER (PARTITION BY title) AS n FROM m) SELECT a.id, b.id AS step_id FROM n a JOIN n b ON a.title = b.title AND b.at_row = least(a.n, a.at_row + 5)"),
    "stage_states": (stage_states, f"WITH {MANIFESTS} SELECT id, " + ", ".join(f"CASE WHEN status = 'completed' OR stage = 'done' OR {_STAGE} > {k + 1} THEN 'done' WHEN {_STAGE} = {k + 1} THEN CASE WHEN status IN ('failed', 'cancelled') THEN status ELSE 'running' END ELSE 'waiting' END AS {s}" for k, s in enumerate(predicates.STAGES)) + " FROM m"),
    "elapsed_times": (elapsed_times, f"WITH {MANIFESTS}, e AS (SELECT id, {_MS} AS elapsed_ms FROM b) SELECT id, elapsed_ms, CASE WHEN elapsed_ms // 3600000 > 0 THEN printf('%d:%02d:%02d', elapsed_ms // 3600000, elapsed_ms // 60000 % 60, elapsed_ms // 1000 % 60) ELSE printf('%d:%02d', elapsed_ms // 60000, elapsed_ms // 1000 % 60) END AS elapsed FROM e"),
    "relative_times": (relative_times, f"WITH {MANIFESTS}, r AS (SELECT id, (updated_at AT TIME ZONE 'UTC') + INTERVAL 28 DAYS AS a, TIMESTAMP '{NOW}' AS now FROM m), s AS (SELECT *, epoch_ms(now) - epoch_ms(a) AS ms FROM r) SELECT id, CASE WHEN ms < 60000 THEN '刚刚' WHEN ms < 3600000 THEN (ms // 60000) || ' 分钟前' WHEN a::DATE = now::DATE - 1 THEN '昨天' WHEN a::DATE = now::DATE THEN greatest(1, ms // 3600000) || ' 小时前' WHEN year(a) = year(now) THEN month(a) || '月' || day(a) || '日' ELSE year(a) || '年' || month(a) || '月' || day(a) || '日' END AS told FROM s"),
    "promote_due": (promote_due, f"WITH {MANIFESTS} SELECT id, CASE WHEN status = 'retrying' AND coalesce(next_attempt_at, {_NOW}) <= {_NOW} THEN 'queued' ELSE status END AS status FROM m"),
    "recover_after_crash": (recover_after_crash, f"WITH {MANIFESTS} SELECT CASE WHEN status IN ('processing', 'retrying') THEN 'queued' ELSE status END AS status, count(*) AS n FROM m GROUP BY 1"),
    "compare_and_set": (compare_and_set, f"WITH {MANIFESTS} SELECT id, CASE WHEN status = 'processing' AND quality = 1 THEN 'completed' WHEN status = 'processing' AND quality IS NOT NULL THEN 'failed' ELSE status END AS status, status = 'processing' AND quality IS NOT NULL AS changed FROM m LEFT JOIN labels ON doc_id = id"),
    "enabled_translators": (enabled_translators, "SELECT c_nationkey AS provider_id, c_mktsegment AS model FROM (SELECT *, sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS balance FROM customer) WHERE c_nationkey % 2 = 0 AND (balance > 0 OR c_nationkey % 3 = 0) GROUP BY ALL"),
    "filename_sanitize": (filename_sanitize, f"SELECT page_id, CASE WHEN {_CLEAN} = '' THEN '文档' ELSE left({_CLEAN}, 120) END AS name, list_last(string_split_regex(url, '[\\\\/]')) AS base, list_last(string_split_regex(url, '[\\\\/]')) AS stem FROM pages"),
    "unique_names": (unique_names, "SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '#' || (r - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)"),
    "document_ids": (document_ids, f"WITH {MANIFESTS} SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y%m%dT%H%M%S') || '-' || left(sha256(title), 6) AS name FROM m"),
    "size_format": (size_format, f"SELECT doc_id, {_bytes('(n_chars * n_chars)')} AS size, {_bytes('n_chars')} AS small FROM documents"),
    "version_compare": (version_compare, f"WITH v AS (SELECT l_linenumber || '.' || l_quantity::INT AS a, 'v' || (l_partkey % 7) || '-' || (l_suppkey % 50) || '-rc' AS b FROM lineitem), g AS (SELECT a, b, count(*) AS n FROM v GROUP BY a, b) SELECT a, b, n, coalesce(list_filter(list_transform(list_zip({_NUMS('a')}, {_NUMS('b')}), lambda p: coalesce(p[1], 0) - coalesce(p[2], 0)), lambda x: x <> 0)[1] > 0, false) AS newer FROM g"),
    "permanent_errors": (permanent_errors, "SELECT o_orderkey, code, code IN ('pdf_encrypted', 'not_found', 'page_geometry') AS permanent FROM (SELECT o_orderkey, (['pdf_encrypted', 'verify_failed', 'not_found', 'internal', 'page_geometry', 'worker_crashed', 'cancelled'])[o_orderkey % 7 + 1] AS code FROM orders)"),
}
