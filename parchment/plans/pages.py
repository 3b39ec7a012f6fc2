"""Named queries over characters, placeholders, glyph names, requests and outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import tokens
from parchment.operators import segments
from parchment.plans.base import SPACE, table


def nfkc_spaces(spark, d):
    docs = table(spark, d, "documents").withColumn("made", F.concat(F.lit("ﬁ ①　"), F.col("text")))
    return docs.select("doc_id", tokens.normalize_spaces(F.col("made")).alias("plain"))


def nfkc_texts(spark, d):
    """Texts alone. NFKC has no SQL; that of nfkc_spaces knows what becomes of its first signs, and that the given texts are in that form."""
    return table(spark, d, "documents").select("doc_id", tokens.normalize_spaces(F.col("text")).alias("plain"))


def _marked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"\bthe\b", "{v1}"), r"\bof\b", "{v2}").alias("text"))


def placeholder_counts(spark, d):
    return _marked(spark, d).select("doc_id", F.explode(tokens.placeholders(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def placeholder_cleanup(spark, d):
    allowed = F.array(F.lit("{v1}"), F.lit("{v3}"))
    return _marked(spark, d).select("doc_id", tokens.without_foreign(F.col("text"), allowed).alias("clean"), F.array_join(tokens.lost(F.col("text"), allowed), ",").alias("lost"))


def glyph_names(spark, d):
    known = F.create_map(F.lit("A"), F.lit("A"), F.lit("fi"), F.lit("ﬁ"))
    code = F.lpad(F.hex(F.pmod("p_partkey", F.lit(900)) + 65), 4, "0")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("uni"), code, F.lit("0041.alt"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("u"), code)).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("fi_A_uni"), code)).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), tokens.glyph_text(name, known).alias("text"))


def provider_urls(spark, d):
    kind = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("gemini")), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    base = F.when(F.col("page_id") % 5 == 0, "http://localhost:8080/v1/").otherwise(F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("//")))
    return table(spark, d, "pages").select("page_id", tokens.chat_url(kind, base, F.lit("models/m1")).alias("url"), tokens.key_optional(base).alias("optional"))


def request_bodies(spark, d):
    kind = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("gemini")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    body = tokens.request_body(kind, F.lit("m1"), F.lit("be brief"), F.col("text"))
    said = F.coalesce(F.get_json_object(body, "$.messages[1].content"), F.get_json_object(body, "$.messages[0].content"), F.get_json_object(body, "$.contents[0].parts[0].text"))
    told = F.coalesce(F.get_json_object(body, "$.system"), F.get_json_object(body, "$.systemInstruction.parts[0].text"), F.get_json_object(body, "$.messages[0].content"))
    return table(spark, d, "conversations").select("conv_id", "turn", said.alias("user"), told.alias("system"))


def settings_merge(spark, d):
    base, extra = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("event_type")), F.from_json(F.col("props"), "map<string,string>")
    merged = tokens.merged_settings(base, F.map_concat(extra, F.create_map(F.lit("b"), F.col("user_id").cast("string"))))
    return table(spark, d, "events").select("event_id", *[F.try_element_at(merged, F.lit(k)).alias(k) for k in ("a", "b", "k")])


def _chars(spark, d):
    """Line items of a supplier as characters in order of their orders."""
    order = F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    x = F.pmod(F.col("l_orderkey") / 10, F.lit(500.0)) + F.pmod("l_partkey", F.lit(200))
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", order.alias("ord"), x.alias("x0")).agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("font"), F.min("l_linestatus").alias("cls"), F.min("l_linenumber").alias("line"))
    return rows.select("l_suppkey", "ord", "x0", (F.col("x0") + F.col("q")).alias("x1"), "font", "cls", F.when(F.col("q") > 25, 12.0).otherwise(10.0).alias("size"), F.col("line").cast("double").alias("y"), F.col("font").alias("text"))


def layout_segments(spark, d):
    return segments.segments(_chars(spark, d), ["l_suppkey"], "ord", F.lit(800.0)).select("l_suppkey", F.col("segment").cast("long").alias("segment"), "first", "last", "x0", "x1", "n")


def base_styles(spark, d):
    return segments.base_style(_chars(spark, d), ["l_suppkey"], "ord")


def glyph_runs(spark, d):
    glyphs = _chars(spark, d).withColumns({"size": F.lit(10.0), "y": F.floor(F.col("x0") / 300).cast("double")})
    return segments.glyph_runs(glyphs, ["l_suppkey"], "ord", slack=200.0).select("l_suppkey", F.col("run").cast("long").alias("run"), "text", "n")


def spaced_texts(spark, d):
    chars = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("text")))).alias("c"))
    boxes = F.transform("c", lambda c, i: F.struct(c["text"].alias("text"), (i * 10 + F.pmod(c["k"], F.lit(9))).cast("double").alias("x0"), (i * 10 + F.pmod(c["k"], F.lit(9)) + 6).cast("double").alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1")))
    placed = chars.select("l_orderkey", boxes.alias("c"))
    return placed.select("l_orderkey", tokens.spaced_text(F.col("c")).alias("text"))


def _starts(spark, d):
    e = table(spark, d, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1)
    glyphs = e.select(F.col("user_id").alias("page"), "seq", F.lit("").alias("path"), F.floor("value").cast("double").alias("x"), F.lit(1.0).alias("y"))
    shift = F.when(F.pmod("user_id", F.lit(3)) == 0, 0.0).when(F.pmod("user_id", F.lit(3)) == 1, F.when(F.col("event_id") % 7 == 0, 5.0).otherwise(0.5)).otherwise(0.0)
    operators = e.select(F.col("user_id").alias("page"), "seq", F.when((F.pmod("user_id", F.lit(9)) == 2) & (F.col("seq") == 3), "1").otherwise("").alias("path"), (F.floor("value") + shift).alias("x"), F.lit(1.0).alias("y"))
    return glyphs, operators


def operator_agreement(spark, d):
    return segments.agreement(*_starts(spark, d), ["page"]).select("page", "same_path", F.round("agree", 9).alias("agree"), "trusted")


def operator_matches(spark, d):
    return segments.match_in_order(*_starts(spark, d), "page")


def outline_depths(spark, d):
    """Parts as outline items under the seventh of their number; a cycle among the last ones."""
    parts = table(spark, d, "part")
    last = parts.agg(F.max("p_partkey")).first()[0]
    parent = F.when(F.col("p_partkey") == 0, F.lit(None)).when(F.col("p_partkey") == last, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 7))
    return segments.descend(parts.select("p_partkey", parent.alias("parent")), "p_partkey", "parent").groupBy("depth").agg(F.count("*").alias("n"), F.max("p_partkey").alias("greatest"))


def page_verification(spark, d):
    o = table(spark, d, "orders")
    expected = o.filter(F.col("o_orderkey") % 5 > 0).select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("width"), F.lit(800.0).alias("height"))
    actual = o.filter(F.col("o_orderkey") % 7 > 0).select("o_orderkey", (F.floor(F.col("o_totalprice") / 1000) + F.col("o_orderkey") % 3).alias("width"), F.lit(800.5).alias("height"))
    return segments.verify_pages(expected, actual, ["o_orderkey"])


_CHARS = """c AS (SELECT l_suppkey, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS ord, (l_orderkey / 10) % 500.0::DOUBLE + l_partkey % 200 AS x0, min(l_quantity) AS q, min(l_returnflag) AS font, min(l_linestatus) AS cls, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT l_suppkey, ord, x0, x0 + q AS x1, font, cls, CASE WHEN q > 25 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM c)"""
_KIND = "(['openai', 'anthropic', 'gemini'])[%s %% 3 + 1]"
_TEXT = r"regexp_replace(regexp_replace(text, '\bthe\b', '{v1}', 'g'), '\bof\b', '{v2}', 'g')"
_STARTS = """e AS (SELECT user_id, event_id, floor(value) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, CASE WHEN user_id % 3 = 1 THEN CASE WHEN event_id % 7 = 0 THEN 5.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END AS shift FROM events)"""

QUERIES = {
    "nfkc_spaces": (nfkc_spaces, f"SELECT doc_id, regexp_replace('fi 1 ' || text, '[{SPACE}]+', ' ', 'g') AS plain FROM documents"),
    "nfkc_texts": (nfkc_texts, None),
    "placeholder_counts": (placeholder_counts, rf"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_TEXT}, '\{{v\d+\}}')) AS token FROM documents) GROUP BY ALL"),
    "placeholder_cleanup": (placeholder_cleanup, f"SELECT doc_id, replace({_TEXT}, '{{v2}}', '') AS clean, CASE WHEN contains({_TEXT}, '{{v1}}') THEN '{{v3}}' ELSE '{{v1}},{{v3}}' END AS lost FROM documents"),
    "glyph_names": (glyph_names, "WITH h AS (SELECT p_partkey, p_name, printf('%04X', p_partkey % 900 + 65) AS h, chr((p_partkey % 900 + 65)::INT) AS c FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'uni' || h || '0041.alt' WHEN 1 THEN 'u' || h WHEN 2 THEN 'fi_A_uni' || h ELSE p_name END AS name, CASE p_partkey % 4 WHEN 0 THEN c || 'A' WHEN 1 THEN c WHEN 2 THEN 'ﬁA' || c END AS text FROM h"),
    "provider_urls": (provider_urls, f"WITH u AS (SELECT page_id, {_KIND % 'page_id'} AS kind, CASE WHEN page_id % 5 = 0 THEN 'http://localhost:8080/v1' ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) END AS base FROM pages) SELECT page_id, CASE kind WHEN 'openai' THEN base || '/chat/completions' WHEN 'anthropic' THEN CASE WHEN ends_with(base, '/v1') THEN base || '/messages' ELSE base || '/v1/messages' END ELSE base || '/v1beta/models/m1:generateContent' END AS url, page_id % 5 = 0 AS optional FROM u"),
    "request_bodies": (request_bodies, "SELECT conv_id, turn, text AS \"user\", 'be brief' AS system FROM conversations"),
    "settings_merge": (settings_merge, "SELECT event_id, '1' AS a, user_id::VARCHAR AS b, props->>'$.k' AS k FROM events"),
    "layout_segments": (layout_segments, f"WITH {_CHARS}, m AS (SELECT *, coalesce((cls <> lag(cls) OVER w OR lag(x1) OVER w - x0 > 200)::INT, 1) AS cut FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY ord)), s AS (SELECT *, sum(cut) OVER (PARTITION BY l_suppkey ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM m) SELECT l_suppkey, segment, min(ord) AS first, max(ord) AS last, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY l_suppkey, segment"),
    "base_styles": (base_styles, f"WITH {_CHARS}, f AS (SELECT l_suppkey, font, count(*) AS n, min(ord) AS o FROM g GROUP BY l_suppkey, font), f1 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o) = 1), s AS (SELECT l_suppkey, size, count(*) AS n, min(ord) AS o FROM g GROUP BY l_suppkey, size), s1 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, o) = 1) SELECT l_suppkey, font, size FROM f1 JOIN s1 USING (l_suppkey)"),
    "glyph_runs": (glyph_runs, f"WITH {_CHARS}, m AS (SELECT *, coalesce((NOT (font = lag(font) OVER w AND floor(x0 / 300) = floor(lag(x0) OVER w / 300) AND abs(x0 - lag(x1) OVER w) <= 200))::INT, 1) AS new FROM g WINDOW w AS (PARTITION BY l_suppkey ORDER BY ord)), r AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m) SELECT l_suppkey, run, string_agg(font, '' ORDER BY ord) AS text, count(*) AS n FROM r GROUP BY l_suppkey, run"),
    "spaced_texts": (spaced_texts, """WITH c AS (SELECT l_orderkey, l_returnflag AS t, row_number() OVER w - 1 AS i, l_partkey % 9 AS k, lead(l_partkey % 9) OVER w AS k2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)),
g AS (SELECT *, 4 + k2 - k AS gap FROM c), w AS (SELECT l_orderkey, list_sort(list_distinct(list(gap) FILTER (WHERE gap > 1))) AS gs FROM g GROUP BY l_orderkey)
SELECT l_orderkey, string_agg(t || CASE WHEN gap >= CASE WHEN coalesce(len(gs), 0) = 0 THEN 1 WHEN len(gs) = 1 THEN gs[1] ELSE gs[2] END THEN ' ' ELSE '' END, '' ORDER BY i) AS text FROM g JOIN w USING (l_orderkey) GROUP BY l_orderkey"""),
    "operator_agreement": (operator_agreement, f"WITH {_STARTS}, m AS (SELECT user_id AS page, NOT (user_id % 9 = 2 AND seq = 3) AS same, shift <= 1 AS near FROM e) SELECT page, bool_and(same) AS same_path, round(avg((same AND near)::INT), 9) AS agree, bool_and(same) AND avg((same AND near)::INT) >= 0.95 AS trusted FROM m GROUP BY page"),
    "operator_matches": (operator_matches, f"""WITH RECURSIVE {_STARTS}, f AS (
  SELECT user_id, -1::BIGINT AS seq, -1::BIGINT AS cursor, NULL::BIGINT AS op FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, seq, coalesce(op, cursor), op FROM (
    SELECT g.user_id, g.seq, f.cursor, (SELECT min(o.seq) FROM e o WHERE o.user_id = g.user_id AND o.seq > f.cursor AND abs(o.x + o.shift - g.x) <= 1) AS op FROM f JOIN e g ON g.user_id = f.user_id AND g.seq = f.seq + 1)
) SELECT user_id AS page, seq, op AS op_seq FROM f WHERE op IS NOT NULL"""),
    "outline_depths": (outline_depths, "WITH RECURSIVE t AS (SELECT p_partkey, 0 AS depth FROM part WHERE p_partkey = 0 UNION ALL SELECT p.p_partkey, depth + 1 FROM part p JOIN t ON p.p_partkey > 0 AND p.p_partkey < (SELECT max(p_partkey) FROM part) AND p.p_partkey // 7 = t.p_partkey) SELECT depth, count(*) AS n, max(p_partkey) AS greatest FROM t GROUP BY depth"),
    "page_verification": (page_verification, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 3 > 1 THEN 'size' END AS wrong FROM orders WHERE o_orderkey % 5 > 0 OR o_orderkey % 7 > 0"),
}
