"""Named queries over paragraphs, batches, glossaries and replies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import numbers, predicates, text
from parchment.operators import batching, glossary, replies
from parchment.plans.base import SPACE, TURNS, sql_strip, sql_words, table, turns


def paragraph_explode(spark, d):
    return batching.paragraphs(table(spark, d, "documents")).select("doc_id", F.col("ord").cast("long").alias("ord"), "line")


def _kept(line):
    return ~predicates.is_cid(line) & ~predicates.is_numeric(line) & ~predicates.is_placeholder_only(line)


def paragraph_filters(spark, d):
    p = batching.paragraphs(table(spark, d, "documents"))
    marked = p.withColumn("line", F.regexp_replace("line", r"\b(the|de|der)\b", "{v1}"))
    c = F.col("line")
    return marked.select("doc_id", F.col("ord").cast("long").alias("ord"), predicates.needs_translation(c).alias("needs"), predicates.is_numeric(c).alias("numeric"), predicates.is_cid(c).alias("cid"), predicates.is_placeholder_only(c).alias("bare"), predicates.looks_like_title(c).alias("titled"))


def formula_chars(spark, d):
    """The characters of all texts, and which belong to formulas."""
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n")).withColumn("formula", predicates.is_formula_char(F.col("ch")))


def pack_term_batches(spark, d):
    return batching.pack_lines(table(spark, d, "documents"), *batching.TERMS, _kept)


def pack_translate_batches(spark, d):
    return batching.pack_lines(table(spark, d, "documents"), *batching.TRANSLATE, lambda t: _kept(t) & (F.length(t) >= 5))


def batch_order(spark, d):
    batches = pack_translate_batches(spark, d)
    return batching.submission_order(batches, ["doc_id"], ["batch"]).select("doc_id", "batch", "place")


def batch_totals(spark, d):
    return pack_translate_batches(spark, d).agg(F.sum("n_items").alias("paragraphs"), F.count("*").alias("batches"), F.sum("tokens").alias("tokens"))


def last_title_context(spark, d):
    p = batching.paragraphs(table(spark, d, "documents"))
    titled = F.length("line").between(3, 40)
    return batching.title_context(p, ["doc_id"], ["ord"], titled, F.col("line")).select("doc_id", F.col("ord").cast("long").alias("ord"), "title", "local_title")


def cross_page_pairs(spark, d):
    """Documents as pages of their source; long lines are running text."""
    eligible = F.filter(F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(i.alias("ord"), F.length(t).alias("n"))), lambda x: x["n"] > 200)
    pages = table(spark, d, "documents").select("source", "doc_id", eligible.alias("e"))
    pages = pages.select("source", "doc_id", F.size("e").alias("n"), F.try_element_at("e", F.lit(1))["ord"].cast("long").alias("first_ord"), F.try_element_at("e", F.lit(-1))["ord"].cast("long").alias("last_ord"))
    return batching.cross_page_pairs(pages, ["source"], "doc_id", "first_ord", "last_ord", "n").select("source", "doc_id", "next_page", "last", "head")


def cross_column_pairs(spark, d):
    p = batching.paragraphs(table(spark, d, "documents")).withColumn("top", F.length("line"))
    return batching.cross_column_pairs(p, ["doc_id"], "ord", "top").select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("pair").cast("long").alias("pair"))


def wrapped_lines(spark, d):
    lines = batching.wrap_lines(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 60)
    return table(spark, d, "benchmark").select("item_id", F.size(lines).cast("long").alias("n_lines"), F.element_at(lines, 1).alias("first_line"), F.element_at(lines, -1).alias("last_line"))


def _terms(spark, d):
    """The names of parts and their words as source terms, the name in capitals as a stand-in for a translation."""
    words = F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_name")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.explode(words).alias("source"), F.upper("p_name").alias("target"))


def glossary_dedupe(spark, d):
    w = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit("  "))).alias("source"), "p_brand")
    return glossary.dedupe(w, []).select("ord", "source", "p_brand")


def glossary_match(spark, d):
    terms = glossary.dedupe(_terms(spark, d).withColumn("ord", F.col("ord") * 2), [])
    found = glossary.matches(table(spark, d, "documents"), terms)
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join(F.transform("terms", lambda t: t["source"]), ",").alias("sources"))


def glossary_mode(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey")
    return glossary.most_frequent(li.select("p_name", "p_brand", order.alias("ord")), "p_name", "p_brand", "ord")


def glossary_tables(spark, d):
    terms = table(spark, d, "part").select("p_type", F.col("p_name").alias("source"), F.col("p_brand").alias("target")).distinct()
    return glossary.table_text(terms, ["p_type"])


def key_lists(spark, d):
    raw = F.concat_ws("; ", "url", F.left("url", F.lit(8)))
    return table(spark, d, "pages").select("page_id", F.size(text.split_keys(raw)).cast("long").alias("n"), text.mask_key(raw).alias("masked"), text.redact(F.col("url"), ["example", "www"]).alias("redacted"), text.snippet(F.col("url"), 20).alias("snippet"))


def templates(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", text.substitute(F.lit("$name costs $$5, $missing"), {"name": F.col("p_name")}).alias("a"), text.fill_braces(F.lit("{{{name}}} of {brand}"), {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("b"))


def page_range_filter(spark, d):
    """Turns as pages, from 1; the conversation tells which pages are wanted."""
    specs = ["1-3,5,8-", "-2", "", "2", "7-9, 1", "x"]
    c = table(spark, d, "conversations").withColumn("spec", F.element_at(F.array(*map(F.lit, specs)), (F.pmod("conv_id", F.lit(6)) + 1).cast("int")))
    return c.select("conv_id", "turn", "spec", predicates.page_selected(F.col("spec"), F.col("turn") + 1).alias("selected"), predicates.page_range_problem(F.col("spec")).alias("problem"))


def reply_clean(spark, d):
    wrapped = F.concat(F.lit(" <think>so\nand so</think>"), F.lit("```json"), "reply", F.lit("```\n"))
    return turns(spark, d).select("conv_id", "turn", text.clean_json_output(text.clean_reply(wrapped)).alias("clean"), text.collapse_punctuation(F.concat("reply", F.lit("." * 25))).alias("collapsed"))


def reply_quality(spark, d):
    return turns(spark, d).select("conv_id", "turn", replies.rejected_because(text.ascii_fold(F.col("input")), F.col("reply")).alias("reason"))


def kept_ratio(spark, d):
    t = turns(spark, d).withColumn("kept", F.length("reply") > F.length("input") * 3)
    sums = t.groupBy("conv_id").agg(F.sum(F.when(F.col("kept"), F.length("input")).otherwise(0)).alias("kept_chars"), F.sum(F.length("input")).alias("total_chars"))
    return sums.withColumn("fails", replies.mostly_kept(F.col("kept_chars"), F.col("total_chars")))


def reply_items(spark, d):
    """Batch replies that echo some turns of a conversation, as JSON in a fence."""
    t = turns(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    made = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "reply"))).alias("r"))
    body = F.to_json(F.transform("r", lambda x: F.struct(x["at"].alias("id"), x["reply"].alias("output"))))
    asked = F.size("r") + F.pmod("conv_id", F.lit(2)).cast("int")
    got = replies.batch_items(made.withColumn("body", F.concat(F.lit("```json\n"), body, F.lit("\n```"))), "body", asked)
    return got.select("conv_id", F.col("items").isNotNull().alias("valid"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n"), F.get("items", F.lit(0))["output"].alias("first"))


def extracted_terms(spark, d):
    b = table(spark, d, "part").select("p_partkey", F.to_json(F.array(F.struct(F.col("p_name").alias("src"), F.upper("p_name").alias("tgt")), F.struct(F.left("p_name", F.lit(2)).alias("src"), F.left("p_name", F.lit(2)).alias("tgt")))).alias("reply"))
    terms = F.col("terms")
    return b.select("p_partkey", replies.extracted_terms(F.col("reply")).alias("terms")).select("p_partkey", F.size(terms).cast("long").alias("n"), F.get(terms, F.lit(0))["tgt"].alias("tgt"))


def error_classify(spark, d):
    statuses = [200, 400, 401, 403, 404, 408, 413, 418, 422, 429, 500, 503, 525, 600]
    bodies = ["rate limit reached", "blocked by safety", "model not found", "insufficient balance", "context length", "invalid api key", "oops"]
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, statuses)), (F.pmod("event_id", F.lit(14)) + 1).cast("int")).alias("status"), F.concat(F.element_at(F.array(*map(F.lit, bodies)), (F.pmod("user_id", F.lit(7)) + 1).cast("int")), F.lit(" "), F.col("props")).alias("body"))
    kind = predicates.classify_http(F.col("status"), F.col("body"))
    return e.select("event_id", "status", kind.alias("kind"), predicates.ends_document(kind).alias("ends"))


def retry_after(spark, d):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    header = F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("soon")
    ms = numbers.retry_after_ms(header, now)
    return table(spark, d, "events").select("event_id", ms.alias("ms"), numbers.backoff_ms(F.pmod("event_id", F.lit(8)) + 1, ms).alias("wait_ms"), numbers.retry_delay_s(F.pmod("event_id", F.lit(3))).alias("delay_s"))


def prompt_cache_join(spark, d):
    t = turns(spark, d)
    cache = t.filter("turn < 3").select(replies.prompt_key(F.col("input")).alias("key"), F.lit("v1").alias("fingerprint"), F.col("reply").alias("text"), F.struct("conv_id", "turn").alias("at"))
    return replies.with_cached(t.select("conv_id", "turn", replies.prompt_key(F.col("input")).alias("key")), cache, "v1")


def results_and_kept(spark, d):
    t = turns(spark, d)
    done = t.filter(F.length("reply") < 900).select("conv_id", "turn", F.col("reply").alias("text"))
    kept = t.filter(F.length("reply") > 500).select("conv_id", "turn", F.col("input").alias("text"))
    return replies.results_and_kept(done, kept, ["conv_id", "turn"])


def fake_replies(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", replies.fake_reply(F.col("text")).alias("reply"))


def reply_texts(spark, d):
    """The three dialects' replies around the same text."""
    body = [F.to_json(F.struct(F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices"))), F.to_json(F.struct(F.array(F.struct(F.col("reply").alias("text")), F.struct(F.lit("!").alias("text"))).alias("content")))]
    dialect = F.when(F.col("turn") % 4 == 0, "chat").otherwise("messages")
    return turns(spark, d).select("conv_id", "turn", replies.reply_text(dialect, F.when(F.col("turn") % 4 == 0, body[0]).otherwise(body[1])).alias("said"))


def json_usage_sum(spark, d):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("tokens"), F.count("*").alias("n"))


def untranslated_pages(spark, d):
    """Documents without a single line that needs translation by its length, by source."""
    lines = F.exists(F.split("text", "\n", -1), lambda t: F.length(t) > 300)
    return table(spark, d, "documents").filter(~lines).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_WORDS = sql_words("line")
_CID = r"CASE WHEN length(line) = 0 THEN false ELSE len(regexp_extract_all(line, '\(cid:\d+\)')) / (len(regexp_extract_all(line, '\(cid:\d+\)')) + length(regexp_replace(line, '\(cid:\d+\)', '', 'g'))) > 0.8 END"
_NUMERIC = rf"regexp_matches({sql_strip('line')}, '^-?\p{{Nd}}+(\.\p{{Nd}}+)?$')"
_BARE = rf"line <> '' AND regexp_matches(regexp_replace(line, '\{{v\d+\}}', '', 'g'), '^[{SPACE}]*$')"
_LINES = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents)"


def _packed(where: str, tokens: int, items: int) -> str:
    return f"""RECURSIVE {_LINES}, k AS (SELECT doc_id, ord, {_WORDS} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM p WHERE NOT ({_CID}) AND NOT ({_NUMERIC}) AND NOT ({_BARE}) {where}),
f AS (
  SELECT doc_id, i, ord, w, 0::BIGINT AS batch, w AS t, 1::BIGINT AS n FROM k WHERE i = 1
  UNION ALL
  SELECT k.doc_id, k.i, k.ord, k.w, CASE WHEN f.t > {tokens} OR f.n > {items} THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.t > {tokens} OR f.n > {items} THEN k.w ELSE f.t + k.w END, CASE WHEN f.t > {tokens} OR f.n > {items} THEN 1 ELSE f.n + 1 END
  FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1
), g AS (SELECT doc_id, batch, sum(w)::BIGINT AS tokens, count(*) AS n_items, min(ord) AS first, max(ord) AS last FROM f GROUP BY doc_id, batch)"""


_TRANSLATED = _packed("AND length(line) >= 5", *batching.TRANSLATE)
_FOLD = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASSIFY = "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN '{k}'" for k, p in predicates.BODY_PATTERNS) + " WHEN contains(b, 'insufficient') AND regexp_matches(b, 'balance|quota|credit') THEN 'credential' END"
_PUNCT = "regexp_replace(%s, '[. 。…，]{20,}', '.', 'g')"
_PARTS = "regexp_extract_all(url || '; ' || left(url, 8), '[^,，\\s;]+')"

QUERIES = {
    "paragraph_explode": (paragraph_explode, f"WITH {_LINES} SELECT doc_id, ord, line FROM p"),
    "paragraph_filters": (paragraph_filters, rf"WITH {_LINES}, q AS (SELECT doc_id, ord, regexp_replace(line, '\b(the|de|der)\b', '{{v1}}', 'g') AS line FROM p), s AS (SELECT *, {sql_strip('line')} AS bare_line FROM q) SELECT doc_id, ord, bare_line <> '' AND NOT regexp_matches(bare_line, '^\{{v\d+\}}$') AS needs, {_NUMERIC} AS numeric, {_CID} AS cid, {_BARE} AS bare, length(bare_line) BETWEEN 3 AND 300 AND NOT ends_with(lower(bare_line), '.pdf') AND NOT regexp_matches(bare_line, '^\d+$') AS titled FROM s"),
    "formula_chars": (formula_chars, r"WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, count(*) AS n, starts_with(ch, '(cid:') OR (ch <> ' ' AND regexp_matches(ch, '^([\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}]|[\x{370}-\x{3FF}])')) AS formula FROM c GROUP BY ch"),
    "pack_term_batches": (pack_term_batches, f"WITH {_packed('', *batching.TERMS)} SELECT * FROM g"),
    "pack_translate_batches": (pack_translate_batches, f"WITH {_TRANSLATED} SELECT * FROM g"),
    "batch_order": (batch_order, f"WITH {_TRANSLATED} SELECT doc_id, batch, row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, batch) AS place FROM g"),
    "batch_totals": (batch_totals, f"WITH {_TRANSLATED} SELECT sum(n_items)::BIGINT AS paragraphs, count(*) AS batches, sum(tokens)::BIGINT AS tokens FROM g"),
    "last_title_context": (last_title_context, f"WITH {_LINES}, t AS (SELECT *, CASE WHEN length(line) BETWEEN 3 AND 40 THEN line END AS titled FROM p), w AS (SELECT doc_id, ord, first_value(titled IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS title, last_value(titled IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM t) SELECT doc_id, ord, title, coalesce(l, title) AS local_title FROM w"),
    "cross_page_pairs": (cross_page_pairs, f"""
WITH RECURSIVE {_LINES}, e AS (SELECT doc_id, count(*) AS n, min(ord) AS a, max(ord) AS z FROM p WHERE length(line) > 200 GROUP BY doc_id),
g AS (SELECT source, documents.doc_id, coalesce(n, 0) AS n, a, z, row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) AS i FROM documents LEFT JOIN e USING (doc_id)),
f AS (
  SELECT source, i, doc_id, n, z, false AS taken, NULL::BIGINT AS prev, NULL::BIGINT AS prev_z, NULL::BIGINT AS a FROM g WHERE i = 1
  UNION ALL
  SELECT g.source, g.i, g.doc_id, g.n, g.z, (f.n - f.taken::INT) >= 1 AND g.n >= 1, f.doc_id, f.z, g.a FROM f JOIN g ON g.source = f.source AND g.i = f.i + 1
) SELECT source, prev AS doc_id, doc_id AS next_page, prev_z AS last, a AS head FROM f WHERE taken"""),
    "cross_column_pairs": (cross_column_pairs, f"""
WITH RECURSIVE {_LINES}, k AS (SELECT doc_id, ord, length(line) AS top, lead(length(line)) OVER (PARTITION BY doc_id ORDER BY ord) AS up FROM p),
f AS (
  SELECT doc_id, ord, coalesce(up - top > 20, false) AS pairs FROM k WHERE ord = 0
  UNION ALL
  SELECT k.doc_id, k.ord, NOT f.pairs AND coalesce(k.up - k.top > 20, false) FROM f JOIN k ON k.doc_id = f.doc_id AND k.ord = f.ord + 1
) SELECT doc_id, ord, ord + 1 AS pair FROM f WHERE pairs"""),
    "wrapped_lines": (wrapped_lines, r"""
WITH RECURSIVE w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark),
f AS (
  SELECT item_id, ws, 1::BIGINT AS i, 1::BIGINT AS n, ws[1] AS line FROM w
  UNION ALL
  SELECT item_id, ws, i + 1, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 60 THEN n ELSE n + 1 END, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 60 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM f WHERE i < len(ws)
) SELECT item_id, max(n) AS n_lines, arg_max(line, i) FILTER (WHERE n = 1) AS first_line, arg_max(line, i) AS last_line FROM f GROUP BY item_id"""),
    "glossary_dedupe": (glossary_dedupe, "SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || '  ' END AS source, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1"),
    "glossary_match": (glossary_match, rf"WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' ') || [p_name])) AS s FROM part), g AS (SELECT s, min(p_partkey) AS o FROM t GROUP BY s), h AS (SELECT doc_id, {_FOLD % f'''regexp_replace(text, '[{SPACE}]+', ' ', 'g')'''} AS hay FROM documents), m AS (SELECT doc_id, s, o FROM h JOIN g ON contains(hay, {_FOLD % 's'})) SELECT documents.doc_id, count(s) AS n_terms, coalesce(string_agg(s, ',' ORDER BY o, s), '') AS sources FROM documents LEFT JOIN m USING (doc_id) GROUP BY documents.doc_id"),
    "glossary_mode": (glossary_mode, "WITH c AS (SELECT p_name, p_brand, count(*) AS n, min(l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name, p_brand) SELECT p_name, p_brand, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, o) = 1"),
    "glossary_tables": (glossary_tables, "SELECT p_type, string_agg('| ' || p_name || ' | ' || p_brand || ' |', chr(10) ORDER BY p_name, p_brand) AS lines FROM (SELECT DISTINCT p_type, p_name, p_brand FROM part) GROUP BY p_type"),
    "key_lists": (key_lists, f"WITH k AS (SELECT page_id, url, {_PARTS} AS ks FROM pages) SELECT page_id, len(ks)::BIGINT AS n, '••••••••' || CASE WHEN length(ks[1]) >= 12 THEN right(ks[1], 4) ELSE '' END || CASE WHEN len(ks) > 1 THEN '（共 ' || len(ks) || ' 个）' ELSE '' END AS masked, replace(replace(url, 'example', '[redacted]'), 'www', '[redacted]') AS redacted, CASE WHEN length(url) <= 20 THEN url ELSE left(url, 20) || '…' END AS snippet FROM k"),
    "templates": (templates, "SELECT p_partkey, p_name || ' costs $5, $missing' AS a, '{' || p_name || '} of ' || p_brand AS b FROM part"),
    "page_range_filter": (page_range_filter, "WITH s AS (SELECT *, (['1-3,5,8-', '-2', '', '2', '7-9, 1', 'x'])[conv_id % 6 + 1] AS spec, turn + 1 AS page FROM conversations) SELECT conv_id, turn, spec, CASE spec WHEN '' THEN true WHEN '1-3,5,8-' THEN page <= 3 OR page = 5 OR page >= 8 WHEN '-2' THEN page <= 2 WHEN '2' THEN page = 2 WHEN '7-9, 1' THEN page BETWEEN 7 AND 9 OR page = 1 END AS selected, CASE WHEN spec = 'x' THEN 'form' END AS problem FROM s"),
    "reply_clean": (reply_clean, f"WITH {TURNS} SELECT conv_id, turn, {sql_strip('reply')} AS clean, {_PUNCT % '''(reply || repeat('.', 25))'''} AS collapsed FROM t"),
    "reply_quality": (reply_quality, rf"WITH {TURNS}, a AS (SELECT conv_id, turn, {_FOLD % 'input'} AS i, reply AS r FROM t), q AS (SELECT *, {_PUNCT % 'i'} AS ci, {_PUNCT % 'r'} AS cr FROM a), n AS (SELECT *, {sql_words('ci')} AS ni, {sql_words('cr')} AS nr FROM q) SELECT conv_id, turn, CASE WHEN ci = cr AND ni > 10 THEN 'unchanged' WHEN ni = 0 THEN 'empty source' WHEN NOT (nr / ni > 0.3 AND nr / ni < 3) THEN 'length' WHEN levenshtein(i, cr) < 5 AND ni > 20 THEN 'hardly changed' END AS reason FROM n"),
    "kept_ratio": (kept_ratio, f"WITH {TURNS}, s AS (SELECT conv_id, sum(CASE WHEN length(reply) > length(input) * 3 THEN length(input) ELSE 0 END)::BIGINT AS kept_chars, sum(length(input))::BIGINT AS total_chars FROM t GROUP BY conv_id) SELECT *, kept_chars > 400 AND kept_chars * 5 > total_chars AS fails FROM s"),
    "reply_items": (reply_items, f"WITH {TURNS} SELECT conv_id, conv_id % 2 = 0 AS valid, CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE 0 END AS n, CASE WHEN conv_id % 2 = 0 THEN arg_min(reply, turn) END AS first FROM t GROUP BY conv_id"),
    "extracted_terms": (extracted_terms, "SELECT p_partkey, 1::BIGINT AS n, upper(p_name) AS tgt FROM part"),
    "error_classify": (error_classify, f"""WITH e AS (SELECT event_id, ([200, 400, 401, 403, 404, 408, 413, 418, 422, 429, 500, 503, 525, 600])[event_id % 14 + 1] AS status, lower((['rate limit reached', 'blocked by safety', 'model not found', 'insufficient balance', 'context length', 'invalid api key', 'oops'])[user_id % 7 + 1] || ' ' || props) AS b FROM events),
s AS (SELECT *, {_CLASSIFY} AS said FROM e), k AS (SELECT event_id, status, CASE WHEN status IN (401, 402) THEN 'credential' WHEN status = 403 THEN CASE WHEN contains(b, 'rate') AND contains(b, 'limit') THEN 'rateLimited' ELSE coalesce(said, 'fatal') END WHEN status = 404 THEN 'fatal'
  WHEN status IN (408, 409, 425, 500, 502, 503, 504) OR status BETWEEN 520 AND 529 THEN 'transient' WHEN status = 429 THEN CASE WHEN contains(b, 'insufficient') THEN 'credential' ELSE 'rateLimited' END WHEN status = 413 THEN 'oversized' WHEN status IN (400, 422) THEN coalesce(said, 'rejected')
  WHEN status BETWEEN 400 AND 499 THEN 'rejected' WHEN status BETWEEN 200 AND 299 THEN coalesce(said, 'transient') ELSE 'transient' END AS kind FROM s) SELECT event_id, status, kind, kind IN ('fatal', 'credential') AS ends FROM k"""),
    "retry_after": (retry_after, "WITH m AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN floor(value) * 1000 WHEN 1 THEN (epoch_ms(date_trunc('second', ts)) - epoch_ms(TIMESTAMP '2024-01-10'))::DOUBLE END AS raw FROM events), c AS (SELECT event_id, CASE WHEN raw IS NOT NULL THEN least(300000.0::DOUBLE, greatest(0.0::DOUBLE, raw)) END AS ms, least(pow(2.0::DOUBLE, event_id % 8), 32.0::DOUBLE) * 1000 AS base FROM m) SELECT event_id, ms, greatest(coalesce(ms, base), base / 2) AS wait_ms, (event_id % 3 + 1) * 20 AS delay_s FROM c"),
    "prompt_cache_join": (prompt_cache_join, f"WITH {TURNS}, c AS (SELECT sha256(input) AS key, arg_max(reply, conv_id * 1000 + turn) AS cached FROM t WHERE turn < 3 GROUP BY 1) SELECT conv_id, turn, sha256(input) AS key, cached FROM t LEFT JOIN c ON c.key = sha256(input)"),
    "results_and_kept": (results_and_kept, f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN length(reply) < 900 THEN reply ELSE input END AS text, length(reply) >= 900 AS kept FROM t"),
    "fake_replies": (fake_replies, f"SELECT conv_id, turn, CASE WHEN {sql_strip('text')} = '' THEN text ELSE text || ' (done)' END AS reply FROM conversations"),
    "reply_texts": (reply_texts, f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN reply ELSE reply || '!' END AS said FROM t"),
    "json_usage_sum": (json_usage_sum, "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens, count(*) AS n FROM events GROUP BY event_type"),
    "untranslated_pages": (untranslated_pages, "SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 300)) = 0 GROUP BY source"),
}
