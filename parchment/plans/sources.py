"""Named queries over replies, glossary files, files taken in, settings, templates and styles; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import jsons, marks, numbers, text
from parchment.functions.tokens import merged_json
from parchment.operators import layout, paragraphs
from parchment.plans.base import SPACE, TURNS, sql_strip, table, turns
from parchment.sources import glossaries, library


def _object(**fields):
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def chat_replies(spark, d):
    """Replies as four dialects send them: with reasoning, thoughts, blocks, tokens, refusals and errors."""
    reply, n = F.col("reply"), F.length("reply")
    say = lambda t, **more: _object(text=t, **more)
    part = lambda t, kind=None, thought=False: say(t, type=F.lit(kind).cast("string"), thought=F.when(F.lit(thought), True))
    message = lambda content: F.array(_object(message=_object(content=content), finish_reason=F.lit("length")))
    bodies = [
        _object(choices=message(F.concat(F.lit("\n<Thinking>so\nso</THINKING>\n"), reply)), usage=_object(prompt_tokens=n, completion_tokens=F.lit(5))),
        _object(choices=F.array(_object(message=_object(content=F.array(part(reply, "text"), part(F.lit("!"), None, True), part(F.lit("?"), "text", True))), finish_reason=F.lit("stop"))), usage=_object(prompt_tokens=n, completion_tokens=F.lit("5"))),
        _object(content=F.array(part(reply, "text"), part(F.lit("no"), "thinking")), stop_reason=F.lit("refusal"), usage=_object(input_tokens=n, output_tokens=F.lit(0))),
        _object(candidates=F.array(_object(content=_object(parts=F.array(part(reply), part(F.lit("t"), None, True))), finishReason=F.when(F.col("turn") % 4 == 0, "SAFETY").otherwise("STOP"))), usageMetadata=_object(promptTokenCount=n, candidatesTokenCount=F.lit(7))),
        _object(promptFeedback=_object(blockReason=F.lit("OTHER")), candidates=F.array(_object(content=_object(parts=F.array(part(reply)))))),
        _object(error=_object(message=reply, code=F.lit(3)), choices=message(reply)),
    ]
    k = F.pmod(F.col("conv_id") * 7 + F.floor(F.col("turn") / 2), F.lit(6))
    body = F.coalesce(*[F.when(k == i, F.to_json(b)) for i, b in enumerate(bodies)])
    dialect = F.element_at(F.array(*map(F.lit, ["openai", "azure", "anthropic", "gemini", "gemini", "openai"])), (k + 1).cast("int"))
    return turns(spark, d).select("conv_id", "turn", jsons.chat_reply(dialect, body).alias("r")).select("conv_id", "turn", "r.*")


_REPLIES = f"""
WITH {TURNS}, k AS (SELECT *, (conv_id * 7 + turn // 2) % 6 AS k, regexp_replace(reply, '^[{SPACE}]+', '') AS bare FROM t)
SELECT conv_id, turn, CASE k WHEN 0 THEN bare WHEN 1 THEN reply || '?' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE reply END AS text,
  CASE WHEN k = 0 THEN 'truncated' WHEN k IN (2, 4) OR (k = 3 AND turn % 4 = 0) THEN 'refused' WHEN k < 5 THEN 'complete' END AS finish,
  CASE WHEN k IN (0, 2, 3) THEN length(reply) END AS input, CASE k WHEN 0 THEN 5 WHEN 2 THEN 0 WHEN 3 THEN 7 END::BIGINT AS output, CASE WHEN k = 5 THEN reply END AS error
FROM k"""


def python_strings(spark, d):
    """Values of all kinds as Python writes them."""
    kinds = [F.to_json(F.array("event_type")), F.lit("null"), F.lit(" true "), F.lit("false"), F.col("value").cast("string"), F.concat(F.lit('{"b": '), "user_id", F.lit(', "a": [1, "x", null]}')), F.concat("event_id", F.lit(".500"))]
    k = F.pmod("event_id", F.lit(7))
    json = F.coalesce(F.when(k == 0, F.regexp_replace(kinds[0], r"^\[|\]$", "")), *[F.when(k == i, v) for i, v in enumerate(kinds) if i])
    return table(spark, d, "events").select("event_id", jsons.python_str(json).alias("said"))


def _glossary_files(spark, d):
    """Parts as glossaries by brand: quotes inside and at the start of fields, short rows, blank ones and other languages. Brands on 5 lack the columns."""
    p = table(spark, d, "part").withColumn("k", F.pmod("p_partkey", F.lit(5)))
    line = F.when(F.col("k") == 0, F.concat(F.lit('"'), "p_name", F.lit(', ""x""",'), "p_partkey", F.lit(",zh-CN"))).when(F.col("k") == 1, F.concat("p_name", F.lit(' 5" pipe,'), "p_partkey")).when(F.col("k") == 2, F.concat("p_name", "p_partkey")).when(F.col("k") == 3, F.concat("p_name", F.lit(",other,ja"))).otherwise("")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\r\n")
    header = F.when(F.col("p_brand").endswith("5"), "source,b").otherwise("﻿source,target,tgt_lng")
    files = p.groupBy("p_brand").agg(lines.alias("lines")).select(F.col("p_brand").alias("id"), F.encode(F.concat(header, F.lit("\r\n"), "lines"), "utf-8").alias("content"))
    wanted = files.select("id").unionByName(table(spark, d, "supplier").select(F.concat(F.lit("gone-"), "s_suppkey").alias("id")))
    known = table(spark, d, "part").filter("p_brand like '%2'").select(F.col("p_brand").alias("id"), F.upper("p_brand").alias("name")).distinct()
    return glossaries.load(wanted, known, files, "zh_cn")


def glossary_files(spark, d):
    return _glossary_files(spark, d)[0].select("id", "name", "source", "target")


def glossary_failures(spark, d):
    return _glossary_files(spark, d)[1].select("id", "why")


_FILES = """
WITH r AS (SELECT p_brand, p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ', "x"' WHEN 1 THEN p_name || ' 5" pipe' WHEN 2 THEN p_name || p_partkey END AS source, CASE WHEN p_partkey % 5 = 2 THEN '' ELSE p_partkey::VARCHAR END AS target FROM part WHERE p_partkey % 5 < 3 AND p_brand NOT LIKE '%5')
SELECT p_brand AS id, CASE WHEN p_brand LIKE '%2' THEN upper(p_brand) ELSE p_brand END AS name, source, target FROM r QUALIFY row_number() OVER (PARTITION BY p_brand, lower(source) ORDER BY p_partkey) = 1"""


def pdf_ingest(spark, d):
    """Pages as files, some of them empty, unreadable, without the header or with another ending."""
    k = F.pmod("page_id", F.lit(7))
    content = F.when(k == 0, "").when(k == 1, F.coalesce("html", F.lit("x"))).when(k != 2, F.concat(F.lit("%PDF-1.7\n"), F.coalesce("html", F.lit(""))))
    files = table(spark, d, "pages").select(F.concat("url", F.lit("/"), "page_id", F.when(F.col("page_id") % 5 > 0, ".PDF").otherwise(".txt")).alias("path"), F.encode(content, "utf-8").alias("content"), F.lit(None).cast("long").alias("length"), F.when(F.col("page_id") % 11 == 0, F.col("url")).alias("asked"))
    got = library.ingest(files, F.col("asked"))
    return got.select("path", "created.id", "created.title", "created.bytes", "failure.code")


_INGEST = """
WITH f AS (SELECT page_id, url, url || '/' || page_id || CASE WHEN page_id % 5 > 0 THEN '.PDF' ELSE '.txt' END AS path, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN coalesce(html, 'x') WHEN page_id % 7 <> 2 THEN '%PDF-1.7' || chr(10) || coalesce(html, '') END AS content FROM pages),
c AS (SELECT *, CASE WHEN page_id % 7 = 2 THEN 'unreadable' WHEN content = '' THEN 'empty' WHEN page_id % 5 = 0 THEN 'not a PDF' WHEN NOT starts_with(content, '%PDF-') THEN 'no header' END AS code FROM f)
SELECT path, CASE WHEN code IS NULL THEN sha256(content) END AS id, CASE WHEN code IS NULL THEN left(CASE WHEN page_id % 11 = 0 THEN url ELSE page_id::VARCHAR END, 300) END AS title, CASE WHEN code IS NULL THEN strlen(content) END AS bytes, code FROM c"""


def settings_files(spark, d):
    """The properties of events as settings files; every seventh is cut off, and what is missing has its default."""
    files = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.left("props", F.lit(4))).when(F.col("event_id") % 7 == 1, "{}").otherwise(F.col("props")).alias("value"))
    return library.settings_of(files, "k bigint, theme string", {"k": -1, "theme": "dark"})


def extra_bodies(spark, d):
    """Requests with what users add: objects merge, all else replaces."""
    base = F.concat(F.lit('{"a": {"x": '), "user_id", F.lit(', "y": [1]}, "b": 2, "c": {"d": 1}}'))
    extra = F.when(F.col("event_id") % 5 == 0, "broken").otherwise(F.concat(F.lit('{"a": {"y": ['), "event_id", F.lit(']}, "c": null, "e": {}}')))
    return table(spark, d, "events").select("event_id", merged_json(base, extra).alias("body"))


def template_gaps(spark, d):
    """The names that templates, made of the words of parts, ask for in vain."""
    template = F.concat(F.lit("$$"), F.regexp_replace("p_name", r"(\w+)", r"\$$1"), F.lit(" $name $$no $9 $name"))
    missing = text.missing_names(template, {"name": F.col("p_name")})
    return table(spark, d, "part").select("p_partkey", F.array_join(missing, ",").alias("missing"), text.role_block(F.when(F.col("p_partkey") % 3 > 0, F.concat("p_name", F.when(F.col("p_partkey") % 3 == 1, " \n").otherwise(f" {text.STRICT} "))).otherwise(""), "zh").alias("role"))


def inverse_matrices(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"), F.max("l_linenumber").cast("double").alias("k"))
    m = [F.col("n"), F.lit(0.5), F.when(F.col("l_orderkey") % 9 == 0, F.col("n") * 2).otherwise(-0.5), F.when(F.col("l_orderkey") % 9 == 0, 1.0).otherwise(F.col("k")), F.col("q"), F.lit(3.0)]
    return li.select("l_orderkey", *[(F.round(v, 9) + 0.0).alias(c) for c, v in zip("abcdef", numbers.inverse(m), strict=True)])


def detected_boxes(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("ord"), (F.col("l_discount") * 10).cast("double").alias("conf")).distinct()
    return layout.detected(li, ["l_orderkey"], "ord")


def sized_blanks(spark, d):
    """Line items of an order as characters, of which every third is a blank put in at a line break."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    c = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(at).cast("long").alias("ord"), (F.pmod("l_partkey", F.lit(50)) + F.row_number().over(at) * 10).cast("double").alias("x0"))
    c = c.withColumn("dummy", F.col("ord") % 3 == 0).withColumn("x1", F.when(F.col("dummy"), F.col("x0")).otherwise(F.col("x0") + 5))
    return paragraphs.sized_blanks(c, ["l_orderkey"], "ord")


_SIZED = """
WITH c AS (SELECT *, (l_partkey % 50 + ord * 10)::DOUBLE AS x0 FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem)),
e AS (SELECT *, ord % 3 = 0 AS dummy, CASE WHEN ord % 3 = 0 THEN x0 ELSE x0 + 5 END AS x1, first_value(CASE WHEN ord % 3 > 0 THEN x0 END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM c),
g AS (SELECT l_orderkey, list_sort(list(DISTINCT after - x1) FILTER (WHERE NOT dummy AND after - x1 > 1)) AS gs FROM e GROUP BY l_orderkey),
w AS (SELECT l_orderkey, CASE WHEN coalesce(len(gs), 0) = 0 THEN 1.0::DOUBLE WHEN len(gs) = 1 THEN gs[1] ELSE gs[2] END AS wide FROM g)
SELECT l_orderkey, ord, x0, dummy, CASE WHEN dummy THEN x0 + least(coalesce(abs(after - x0), wide), wide) ELSE x1 END AS x1 FROM e JOIN w USING (l_orderkey)"""


def plain_styles(spark, d):
    """Line items as styled runs beside the style of their order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("font"), (F.col("l_quantity") / 3).alias("size"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linestatus")).alias("gstate"))
    runs = li.select("l_orderkey", "font", "size", "gstate", F.lit("N").alias("base_font"), F.lit(10.0).alias("base_size"), F.lit("O").alias("base_gstate"), F.when(F.col("font") != "R", "serif").alias("mapped"), F.lit("serif").alias("base_mapped"))
    c = F.col
    plain = marks.plain_style(c("font"), c("size"), c("gstate"), c("base_font"), c("base_size"), c("base_gstate"), c("mapped"), c("base_mapped"))
    return runs.groupBy("l_orderkey").agg(F.count_if(plain).alias("plain"), F.count("*").alias("n"))


QUERIES = {
    "chat_replies": (chat_replies, _REPLIES),
    "python_strings": (python_strings, r"""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN 'None' WHEN 2 THEN 'True' WHEN 3 THEN 'False' WHEN 4 THEN regexp_replace(value::VARCHAR, '\.0$', '')
  WHEN 5 THEN '{"b":' || user_id || ',"a":[1,"x",null]}' ELSE event_id || '.5' END AS said FROM events"""),
    "glossary_files": (glossary_files, _FILES),
    "glossary_failures": (glossary_failures, "SELECT DISTINCT p_brand AS id, 'format' AS why FROM part WHERE p_brand LIKE '%5' UNION ALL SELECT 'gone-' || s_suppkey, 'missing' FROM supplier"),
    "pdf_ingest": (pdf_ingest, _INGEST),
    "settings_files": (settings_files, "SELECT event_id, CASE WHEN event_id % 7 > 1 THEN coalesce((props->>'$.k')::BIGINT, -1) ELSE -1 END AS k, 'dark' AS theme, event_id % 7 = 0 AS broken FROM events"),
    "extra_bodies": (extra_bodies, """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"a": {"x": ' || user_id || ', "y": [1]}, "b": 2, "c": {"d": 1}}' ELSE '{"a": {"x": ' || user_id || ', "y": [' || event_id || ']}, "b": 2, "c": null, "e": {}}' END AS body FROM events"""),
    "template_gaps": (template_gaps, f"""
WITH w AS (SELECT p_partkey, p_name, unnest(regexp_extract_all(p_name, '\\w+')) AS word, generate_subscripts(regexp_extract_all(p_name, '\\w+'), 1) AS i FROM part),
f AS (SELECT p_partkey, word, min(i) AS i FROM w WHERE word <> 'name' GROUP BY ALL), m AS (SELECT p_partkey, string_agg(word, ',' ORDER BY i) AS missing FROM f GROUP BY p_partkey)
SELECT p_partkey, coalesce(missing, '') AS missing, CASE p_partkey % 3 WHEN 0 THEN 'You are a professional zh native translator who needs to fluently translate text into zh.' || chr(10) || chr(10) || '{text.STRICT}' WHEN 1 THEN {sql_strip('p_name')} || chr(10) || '{text.STRICT}' ELSE regexp_replace(p_name, '^[{SPACE}]+', '') || ' {text.STRICT}' END AS role FROM part LEFT JOIN m USING (p_partkey)"""),
    "inverse_matrices": (inverse_matrices, """
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS e, count(*)::DOUBLE AS a, max(l_linenumber)::DOUBLE AS k FROM lineitem GROUP BY l_orderkey),
m AS (SELECT l_orderkey, a, 0.5::DOUBLE AS b, CASE WHEN l_orderkey % 9 = 0 THEN a * 2 ELSE -0.5::DOUBLE END AS c, CASE WHEN l_orderkey % 9 = 0 THEN 1.0::DOUBLE ELSE k END AS d, e, 3.0::DOUBLE AS f FROM s), t AS (SELECT *, nullif(a * d - b * c, 0) AS det FROM m)
SELECT l_orderkey, round(d / det, 9) + 0.0::DOUBLE AS a, round(-b / det, 9) + 0.0::DOUBLE AS b, round(-c / det, 9) + 0.0::DOUBLE AS c, round(a / det, 9) + 0.0::DOUBLE AS d, round(-(e * (d / det) + f * (-c / det)), 9) + 0.0::DOUBLE AS e, round(-(e * (-b / det) + f * (a / det)), 9) + 0.0::DOUBLE AS f FROM t"""),
    "detected_boxes": (detected_boxes, "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, ord) - 1 AS box_idx FROM (SELECT DISTINCT l_orderkey, l_linenumber * 1000000 + l_partkey AS ord, (l_discount * 10)::DOUBLE AS conf FROM lineitem) WHERE conf > 0.25"),
    "sized_blanks": (sized_blanks, _SIZED),
    "plain_styles": (plain_styles, """
WITH r AS (SELECT l_orderkey, l_returnflag AS font, l_quantity / 3 AS size, CASE WHEN l_linenumber % 3 > 0 THEN l_linestatus END AS g FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE g = 'O' AND ((font = 'N' AND size > 7 AND size < 13) OR (font <> 'R' AND abs(size - 10) < 0.02))) AS plain, count(*) AS n FROM r GROUP BY l_orderkey"""),
}
