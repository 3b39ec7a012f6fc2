"""Named queries over units of pages, marks in paragraphs, and kept results of stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import marks, numbers, predicates, text
from parchment.operators import glossary, segments, units
from parchment.plans.base import table


def _parts(spark, d):
    """Line items of sixteen orders as the parts of a paragraph: every third a formula, some runs styled."""
    li = table(spark, d, "lineitem")
    part = F.struct(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"),
        F.when(F.col("l_linenumber") % 3 == 0, "formula").otherwise("run").alias("kind"), F.concat("l_returnflag", F.lit(" "), "l_partkey").alias("text"), (F.col("l_linestatus") == "O").alias("plain"),
    )
    return li.groupBy(F.floor(F.col("l_orderkey") / 16).alias("unit")).agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("whole", F.array_join(F.col("parts.text"), ""))


def marked_paragraphs(spark, d):
    sent = _parts(spark, d).select("unit", marks.marked_text(F.col("parts"), F.col("whole")).alias("sent"))
    return sent.select("unit", F.col("sent.text").alias("text"), F.size("sent.marks").cast("long").alias("n_marks"))


def reply_pieces(spark, d):
    """Each paragraph answered by itself, after a mark that was never sent."""
    sent = _parts(spark, d).select("unit", "whole", marks.marked_text(F.col("parts"), F.col("whole")).alias("sent")).filter(F.size("sent.marks") > 0)
    pieces = marks.reply_pieces(F.concat(F.lit("{v999}"), "sent.text"), F.col("sent.marks"), F.col("whole"))
    got = sent.select("unit", pieces.alias("pieces"))
    count = lambda kind: F.size(F.filter("pieces", lambda p: p["kind"] == kind)).cast("long")
    return got.select("unit", count("formula").alias("formulas"), count("original").alias("originals"), count("run").alias("runs"), F.array_join(F.transform(F.filter("pieces", lambda p: p["kind"] == "text"), lambda p: p["text"]), "").alias("plain"))


def translated_units(spark, d):
    c = table(spark, d, "conversations").withColumn("key", units.unit_key(F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    done = c.filter("turn % 2 = 0").select("key", F.upper("role").alias("translation"))
    return units.attach(c.select("key", "text"), done, ["key"])


def reattached_chars(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), "value", "event_type")
    known = e.filter("event_type <> 'error'").select("page", "seq", (-F.col("seq")).alias("ord"))
    return units.reattach(known, e.select("page", "seq"), ["page"])


def decoded_styles(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("l"))
    items = F.transform("l", lambda x: F.struct(x["l_partkey"].cast("string").alias("text"), (F.pmod(x["l_suppkey"], F.lit(5)) - 1).cast("int").alias("style")))
    got = li.select("l_orderkey", units.decode_styles(items, F.array(*map(F.lit, ["bold", "plain", "italic"]))).alias("items"))
    return got.select("l_orderkey", F.array_join(F.transform("items", lambda i: F.concat(i["text"], F.lit(":"), F.coalesce(i["style"], F.lit("none")))), ",").alias("styled"))


def provider_views(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_nationkey").alias("kind"), "s_acctbal")
    presets = table(spark, d, "nation").select(F.col("n_regionkey").alias("kind"), F.col("n_name").alias("preset"), F.col("n_nationkey").alias("ord"))
    return units.provider_view(s.drop("s_acctbal"), s.filter("s_acctbal > 0").select("provider_id"), presets)


def valid_defaults(spark, d):
    defaults = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("provider_id"), (F.col("l_partkey") % 7).alias("model")).distinct()
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("provider_id"), (F.col("s_nationkey") % 7).cast("long").alias("model"))
    return units.valid_defaults(defaults, known)


def translators_by_provider(spark, d):
    li = table(spark, d, "orders").select(F.col("o_custkey").alias("provider_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("model"), F.col("o_orderkey").alias("ord"))
    return units.translators_by_provider(li).select("provider_id", "name", F.array_join("models", ",").alias("models"))


def page_spine(spark, d):
    spine = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"))
    wanted = spine.filter("page % 3 > 0")
    got = units.on_spine(spine, rows, ["page"], wanted)
    return got.select("page", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda i: i["ord"].cast("string")), ",").alias("ords"))


def kept_pages(spark, d):
    p = table(spark, d, "pages").select("page_id")
    return units.kept_pages(p, p.filter("page_id % 4 = 1"), ["page_id"])


def pages_in_both(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"))
    return units.pages_in_both(c, c.filter("page < 3"), ["conv_id"])


def boxes_by_confidence(spark, d):
    e = table(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("conf"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("model_ord")).distinct()
    return units.by_confidence(e, ["l_orderkey"], "model_ord")


def ids_without_case(spark, d):
    p = table(spark, d, "part").select("p_brand", F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.lit("-"), F.col("p_partkey")).alias("id"))
    return units.id_order(p, ["p_brand"], "id")


def analysis_totals(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", F.split("text", "\n", -1).alias("paragraphs"), F.regexp_count("text", F.lit("[0-9]+")).alias("formulas"))
    return units.analysis_totals(docs, ["lang", "source"])


def page_gate(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", units.page_size_ok(F.col("o_totalprice") / 10, F.col("o_custkey") * 1.0).alias("fits"), units.is_visible(F.when(F.col("o_orderkey") % 9 < 8, F.col("o_orderkey") % 9)).alias("visible"))


def stage_cache(spark, d):
    docs = table(spark, d, "documents")
    key = units.stage_key(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit("analyze"), F.when(F.col("doc_id") % 2 == 0, "1-3"), F.lit("4"))
    work = docs.select("doc_id", key.alias("key"))
    kept = docs.filter("doc_id % 3 = 0").select(key.alias("key"), F.col("doc_id").alias("result"), F.col("doc_id").alias("at"), (F.col("n_chars") % 5 > 0).alias("valid"))
    return units.with_stage_cache(work, kept).select("doc_id", "result", "todo")


def cache_upsert(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("key"), F.col("value").alias("text"), F.col("event_id").alias("at"))
    return units.upsert(e.filter("at % 2 = 0"), e.filter("at % 2 = 1").withColumn("at", F.col("at") - 1), "key", "at")


def last_named_glossary(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_type").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("target"))
    return glossary.last_named(p, ["p_brand"], "name", "ord")


def glossary_in_use(spark, d):
    p = table(spark, d, "part").select("p_name", "p_brand", "p_partkey")
    return glossary.in_use(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 5 = 0"), mine=False)


def formula_fonts(spark, d):
    font = F.element_at(F.array(*map(F.lit, ["ABCDEF+CMMI10", "CMR10", "NimbusSans", "X+MSBM7", "MyMono", "TeX-gyre", "CMB5"])), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", font.alias("font"), predicates.is_formula_font(font, ["Nimbus.*"], ["TeX-.*"]).alias("formula"))


def small_numbers(spark, d):
    """Codes in hexadecimal, fixed numbers, progress and time limits of stages."""
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    return o.select(
        "o_orderkey", text.code_hex(n % 65_536, 2).alias("code"), numbers.fixed(F.col("o_custkey") / 8).alias("fixed"), numbers.stage_progress(n % 90, F.lit(80.0), 10, 15).alias("progress"),
        numbers.stage_timeout_ms(n % 100, 3000).alias("limit_ms"), F.element_at(numbers.normalise_colour(F.element_at(F.array(F.lit("gray"), F.lit("rgb"), F.lit("cmyk")), (n % 3 + 1).cast("int")), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75), F.lit(0.5))), 2).alias("green"),
    )


def error_objects(spark, d):
    """Errors inside successful replies; some codes are numbers, some texts, some missing."""
    code = F.element_at(F.array(*map(F.lit, ['"code":401,', '"status":429,', '"code":"401",', '"code":0,"status":503,', ""])), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ["rate limit reached", "blocked by safety", "insufficient balance", "oops"])), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    body = F.concat(F.lit('{"error":{'), code, F.lit('"message":"'), said, F.lit('"}}'))
    kind = predicates.classify_reply(F.lit(200), body)
    e = table(spark, d, "events").select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 3 == 0, 100.0).alias("asked"))
    return e.select("event_id", "kind", predicates.wait_for(F.col("kind"), F.col("asked")).cast("double").alias("wait_ms"))


def text_layer_pages(spark, d):
    """Documents whose lines, as pages, have so few characters that they are taken for scans."""
    sizes = F.transform(F.split("text", "\n", -1), lambda t: F.length(t))
    docs = table(spark, d, "documents").select("doc_id", sizes.alias("n")).withColumn("chars", F.aggregate("n", F.lit(0), lambda a, b: a + b))
    return docs.select("doc_id", predicates.lacks_text_layer(F.col("chars"), F.col("chars") / F.size("n")).alias("scanned"))


def merged_styles(spark, d):
    """Line items of an order as characters; sizes differ little in some, much in others."""
    size = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber") * 0.005 + 10).when(F.col("l_quantity") > 40, 12.0).otherwise(10.0)
    c = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord")).agg(F.min("l_returnflag").alias("font"), F.min(size).alias("size"), F.min("l_linestatus").alias("gstate"))
    return segments.merged_style(c, ["l_orderkey"], "ord")


_PARTS = """p AS (SELECT l_orderkey // 16 AS unit, row_number() OVER w AS i, CASE WHEN l_linenumber % 3 = 0 THEN 'formula' WHEN l_linestatus = 'O' THEN 'plain' ELSE 'rich' END AS kind, l_returnflag || ' ' || l_partkey AS t, count(*) OVER (PARTITION BY l_orderkey // 16) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
k AS (SELECT *, count(*) FILTER (WHERE kind <> 'plain') OVER (PARTITION BY unit) > 40 AS bare FROM p),
q AS (SELECT unit, i, n, t, CASE WHEN kind = 'rich' AND bare THEN 'plain' ELSE kind END AS kind FROM k),
m AS (SELECT *, 1 + coalesce(sum(CASE kind WHEN 'formula' THEN 1 WHEN 'rich' THEN 2 ELSE 0 END) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id FROM q WHERE n > 1 OR kind <> 'formula')"""

QUERIES = {
    "marked_paragraphs": (marked_paragraphs, f"WITH {_PARTS}, s AS (SELECT unit, string_agg(CASE WHEN n = 1 THEN t WHEN kind = 'formula' THEN '{{v' || id || '}}' WHEN kind = 'rich' THEN '<style id=''' || id || '''>' || t || '</style>' ELSE t END, '' ORDER BY i) AS text, count(*) FILTER (WHERE n > 1 AND kind <> 'plain') AS n_marks FROM m GROUP BY unit) SELECT u.unit, s.text, s.n_marks FROM (SELECT DISTINCT unit FROM p) u LEFT JOIN s USING (unit)"),
    "reply_pieces": (reply_pieces, f"WITH {_PARTS} SELECT unit, count(*) FILTER (WHERE kind = 'formula') AS formulas, count(*) FILTER (WHERE kind = 'rich') AS originals, 0::BIGINT AS runs, coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE kind = 'plain'), '') AS plain FROM m WHERE n > 1 GROUP BY unit HAVING count(*) FILTER (WHERE kind <> 'plain') > 0"),
    "translated_units": (translated_units, "SELECT conv_id || '#' || turn AS key, text, CASE WHEN turn % 2 = 0 THEN upper(role) END AS translation FROM conversations"),
    "reattached_chars": (reattached_chars, "SELECT user_id AS page, event_id AS seq, event_type <> 'error' AS matched, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', CASE WHEN event_type <> 'error' THEN -event_id END, event_id) - 1 AS place FROM events"),
    "decoded_styles": (decoded_styles, "SELECT l_orderkey, string_agg(l_partkey || ':' || coalesce((['bold', 'plain', 'italic'])[CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 END], 'none'), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS styled FROM lineitem GROUP BY l_orderkey"),
    "provider_views": (provider_views, "WITH p AS (SELECT n_regionkey AS kind, arg_min(n_name, n_nationkey) AS preset FROM nation GROUP BY 1) SELECT s_nationkey AS kind, s_suppkey AS provider_id, preset, s_acctbal > 0 AS has_key FROM supplier LEFT JOIN p ON kind = s_nationkey"),
    "valid_defaults": (valid_defaults, "SELECT DISTINCT l_suppkey AS provider_id, l_partkey % 7 AS model FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_partkey % 7 = s_nationkey % 7"),
    "translators_by_provider": (translators_by_provider, "SELECT o_custkey AS provider_id, arg_min(o_orderpriority, o_orderkey) AS name, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS models FROM orders GROUP BY o_custkey"),
    "page_spine": (page_spine, "SELECT o_orderkey AS page, count(l_orderkey) AS n, coalesce(string_agg((l_linenumber * 1000000 + l_partkey)::VARCHAR, ',' ORDER BY l_linenumber * 1000000 + l_partkey), '') AS ords FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 3 > 0 GROUP BY o_orderkey"),
    "kept_pages": (kept_pages, "SELECT page_id FROM pages WHERE page_id % 4 <> 1"),
    "pages_in_both": (pages_in_both, "SELECT conv_id, turn AS page FROM conversations WHERE turn < 3"),
    "boxes_by_confidence": (boxes_by_confidence, "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, model_ord) - 1 AS box_idx FROM (SELECT DISTINCT l_orderkey, l_discount AS conf, l_linenumber * 1000000 + l_partkey AS model_ord FROM lineitem)"),
    "ids_without_case": (ids_without_case, "SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY lower(id), id) - 1 AS place FROM (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || '-' || p_partkey AS id FROM part)"),
    "analysis_totals": (analysis_totals, "SELECT lang, source, count(*) AS units, sum(len(string_split(text, chr(10))))::BIGINT AS paragraphs, sum(len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')))::BIGINT AS translatable, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS formulas FROM documents GROUP BY lang, source"),
    "page_gate": (page_gate, "SELECT o_orderkey, o_totalprice / 10 BETWEEN 50 AND 14400 AND o_custkey BETWEEN 50 AND 14400 AS fits, o_orderkey % 9 NOT IN (3, 7) AS visible FROM orders"),
    "stage_cache": (stage_cache, "WITH k AS (SELECT doc_id, sha256(coalesce(text, '')) || (doc_id % 2) AS key, n_chars FROM documents), c AS (SELECT key, max(doc_id) AS result FROM k WHERE doc_id % 3 = 0 AND n_chars % 5 > 0 GROUP BY key) SELECT doc_id, result, result IS NULL AS todo FROM k LEFT JOIN c USING (key)"),
    "cache_upsert": (cache_upsert, "SELECT user_id % 50 AS key, arg_max(value, [event_id - event_id % 2, event_id % 2]) AS text, max(event_id - event_id % 2) AS at FROM events GROUP BY 1"),
    "last_named_glossary": (last_named_glossary, "SELECT p_brand, p_type AS name, min(p_partkey) AS place, arg_max(p_name, p_partkey) AS target FROM part GROUP BY p_brand, p_type"),
    "glossary_in_use": (glossary_in_use, "SELECT p_name, p_brand, p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, p_brand, p_partkey FROM part WHERE p_partkey % 5 = 0"),
    "formula_fonts": (formula_fonts, "SELECT p_partkey, (['ABCDEF+CMMI10', 'CMR10', 'NimbusSans', 'X+MSBM7', 'MyMono', 'TeX-gyre', 'CMB5'])[p_partkey % 7 + 1] AS font, p_partkey % 7 IN (0, 2, 3, 4) AS formula FROM part"),
    "error_objects": (error_objects, "WITH e AS (SELECT event_id, event_id % 5 AS c, user_id % 4 AS s FROM events), k AS (SELECT event_id, CASE c WHEN 0 THEN 'credential' WHEN 1 THEN CASE WHEN s = 2 THEN 'credential' ELSE 'rateLimited' END WHEN 3 THEN 'transient' ELSE (['rateLimited', 'refused', 'credential', 'transient'])[s + 1] END AS kind FROM e) SELECT event_id, kind, CASE WHEN event_id % 3 = 0 THEN 100.0::DOUBLE WHEN kind = 'rateLimited' THEN 5000.0::DOUBLE END AS wait_ms FROM k"),
    "text_layer_pages": (text_layer_pages, "WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, length(replace(text, chr(10), '')) AS chars FROM documents) SELECT doc_id, chars < 200 AND chars / n < 25 AS scanned FROM n"),
    "merged_styles": (merged_styles, """WITH RECURSIVE c AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS ord, min(l_returnflag) AS font, min(CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber * 0.005::DOUBLE + 10 WHEN l_quantity > 40 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END) AS size, min(l_linestatus) AS gstate FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS i FROM c), r AS (
  SELECT l_orderkey, i, font, size, gstate FROM n WHERE i = 1
  UNION ALL
  SELECT n.l_orderkey, n.i, CASE WHEN r.size IS NULL OR r.font = n.font THEN n.font END, CASE WHEN r.size IS NULL THEN n.size WHEN abs(r.size - n.size) < 0.02::DOUBLE THEN r.size END, CASE WHEN r.size IS NULL OR r.gstate = n.gstate THEN n.gstate END FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1
), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i DESC) = 1),
f AS (SELECT l_orderkey, font FROM n GROUP BY l_orderkey, font QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(ord)) = 1), s AS (SELECT l_orderkey, size FROM n GROUP BY l_orderkey, size QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(ord)) = 1)
SELECT l_orderkey, coalesce(l.font, f.font) AS font, coalesce(l.size, s.size) AS size, l.gstate FROM l JOIN f USING (l_orderkey) JOIN s USING (l_orderkey)"""),
    "small_numbers": (small_numbers, "SELECT o_orderkey, printf('%04x', o_orderkey % 65536) AS code, printf('%.6f', o_custkey / 8) AS fixed, 10 + floor(least(1.0::DOUBLE, (o_orderkey % 90) / 80.0::DOUBLE) * 15 + 0.5::DOUBLE)::BIGINT AS progress, greatest(120000, (o_orderkey % 100) * 3000) AS limit_ms, (CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.75 * 0.5 END)::DOUBLE AS green FROM orders"),
}
