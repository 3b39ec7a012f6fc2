"""Named queries over boxes, starts, pixels and planned batches that earlier steps decide on; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import predicates
from parchment.operators import batching, geometry, segments
from parchment.plans.base import sql_words, table
from parchment.plans.layout import BOXES, boxes, separated_overlaps
from parchment.plans.texts import _BARE, _CID, _NUMERIC


def separated_streams(spark, d):
    """Overlaps of boxes of one stream: the kind of box stands for the stream."""
    b = boxes(spark, d).withColumn("box_idx", F.col("box_idx").cast("long"))
    return geometry.separate_overlaps(b, "page", "box_idx", "name")


def separated_sql(keys: str) -> str:
    """Pairs of boxes one after another, round after round, until a round moves nothing; lists hold the edges of a group."""
    put = lambda of, at, v: f"list_concat(list_concat({of}[1 : {at} - 1], [{v}]), {of}[{at} + 1 : ])"
    return f"""
WITH RECURSIVE {BOXES}, g AS (
  SELECT {keys}, count(*) AS n, list(box_idx ORDER BY box_idx) AS ids, list(x0::DOUBLE ORDER BY box_idx) AS l, list(x1::DOUBLE ORDER BY box_idx) AS r, list(y0::DOUBLE ORDER BY box_idx) AS b0, list(y1::DOUBLE ORDER BY box_idx) AS t0 FROM b GROUP BY {keys}
), pairs AS (
  SELECT n, i, j, row_number() OVER (PARTITION BY n ORDER BY i, j) - 1 AS k, n * (n - 1) // 2 AS m FROM (SELECT DISTINCT n FROM g) s, range(1, 20) u(i), range(2, 21) v(j) WHERE i < j AND j <= n
), f AS (
  SELECT {keys}, n, ids, l, r, b0 AS b, t0 AS t, 0::BIGINT AS step, false AS moved, n < 2 AS over FROM g
  UNION ALL
  SELECT {keys}, n, ids, l, r, CASE WHEN hit THEN {put("b", "high", "mid + 1")} ELSE b END, CASE WHEN hit THEN {put("t", "low", "mid - 1")} ELSE t END, step + 1, CASE WHEN last THEN false ELSE moved OR hit END, last AND NOT moved AND NOT hit
  FROM (
    SELECT *, meet AND b[high] < mid AND mid < t[low] AS hit FROM (
      SELECT *, CASE WHEN t[i] < t[j] THEN i ELSE j END AS low, CASE WHEN t[i] < t[j] THEN j ELSE i END AS high, (greatest(b[i], b[j]) + least(t[i], t[j])) / 2 AS mid, k = m - 1 AS last,
        NOT ((b[i] >= b[j] AND t[i] <= t[j]) OR (b[j] >= b[i] AND t[j] <= t[i])) AND least(t[i], t[j]) - greatest(b[i], b[j]) > 1e-6 AND least(r[i], r[j]) - greatest(l[i], l[j]) > 1e-6 AS meet
      FROM f JOIN pairs USING (n) WHERE NOT over AND k = step % m
    )
  )
), done AS (SELECT {keys}, ids, l, r, b, t FROM f WHERE over)
SELECT {keys}, unnest(ids) AS box_idx, unnest(l) AS x0, unnest(b) AS y0, unnest(r) AS x1, unnest(t) AS y1 FROM done"""


def _starts(spark, d):
    """Events as glyphs and operators of a page, with one of three paths of forms; operators lie up to a point and a half to the right."""
    e = table(spark, d, "events").select(F.col("user_id").alias("page"), F.when(F.col("event_id") % 5 > 0, F.lit("")).when(F.col("event_id") % 2 == 0, "1").alias("path"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), F.floor("value").alias("x"), F.floor(F.col("value") / 7).alias("y"), (F.col("event_id") % 4 * 0.5).alias("shift"))
    return e.select("page", "path", "seq", "x", "y"), e.select("page", "path", "seq", (F.col("x") + F.col("shift")).alias("x"), "y")


def operator_path_matches(spark, d):
    return segments.match_in_order(*_starts(spark, d), "page", "path")


_PATHS = """e AS (SELECT user_id AS page, CASE WHEN event_id % 5 > 0 THEN '' WHEN event_id % 2 = 0 THEN '1' END AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, floor(value) AS x, floor(value / 7) AS y, event_id % 4 * 0.5 AS shift FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY page, path ORDER BY seq) AS i FROM e)"""
_PATH_MATCHES = f"""
WITH RECURSIVE {_PATHS}, f AS (
  SELECT page, path, 0::BIGINT AS i, NULL::BIGINT AS seq, -1::BIGINT AS cursor, NULL::BIGINT AS op FROM k GROUP BY page, path
  UNION ALL
  SELECT page, path, i, seq, coalesce(op, cursor), op FROM (
    SELECT g.page, g.path, g.i, g.seq, f.cursor, (SELECT min(o.seq) FROM e o WHERE o.page = g.page AND o.path IS NOT DISTINCT FROM g.path AND o.seq > f.cursor AND pow(o.x + o.shift - g.x, 2) + pow(o.y - g.y, 2) <= 1) AS op
    FROM f JOIN k g ON g.page = f.page AND g.path IS NOT DISTINCT FROM f.path AND g.i = f.i + 1)
) SELECT page, path, seq, op AS op_seq FROM f WHERE op IS NOT NULL"""


def _pixels(spark, d):
    """Embeddings as gray squares, from the first value on again until they are full: vec_id, the side and the pixels in order."""
    gray = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 400 + 128.5))).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", gray.alias("p")).filter(F.size("p") > 0)
    return e.withColumn("side", F.greatest(F.lit(7), F.ceil(F.sqrt(F.size("p")))).cast("int"))


def page_similarity(spark, d):
    """The embeddings as gray images against themselves with the first two rows blanked."""
    cells = F.transform(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1), lambda i: F.struct((i % F.col("side")).alias("x"), F.floor(i / F.col("side")).cast("int").alias("y"), F.get("p", i % F.size("p")).alias("a")))
    pixels = _pixels(spark, d).select(F.col("vec_id").alias("key"), F.explode(cells).alias("c")).select("key", "c.*").withColumn("b", F.when(F.col("y") < 2, 0).otherwise(F.col("a")))
    return geometry.similarity(pixels, "key").withColumn("similarity", F.round("similarity", 9))


_SIMILARITY = """
WITH p AS (SELECT vec_id AS key, list_transform(embedding, lambda v: least(255, greatest(0, floor(v::DOUBLE * 400 + 128.5)))::BIGINT) AS p FROM embeddings WHERE len(embedding) > 0),
s AS (SELECT *, greatest(7, ceil(sqrt(len(p))))::BIGINT AS side FROM p),
c AS (SELECT key, i % side AS x, i // side AS y, p[i % len(p) + 1] AS a FROM (SELECT *, unnest(range(side * side)) AS i FROM s)),
q AS (SELECT key, x, y, a, CASE WHEN y < 2 THEN 0 ELSE a END AS b FROM c),
h AS (SELECT key, x, y, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab FROM q WINDOW w AS (PARTITION BY key, y ORDER BY x ROWS 6 PRECEDING) QUALIFY count(*) OVER w = 7),
v AS (SELECT key, (sum(a) OVER w)::DOUBLE AS a, (sum(b) OVER w)::DOUBLE AS b, (sum(aa) OVER w)::DOUBLE AS aa, (sum(bb) OVER w)::DOUBLE AS bb, (sum(ab) OVER w)::DOUBLE AS ab FROM h WINDOW w AS (PARTITION BY key, x ORDER BY y ROWS 6 PRECEDING) QUALIFY count(*) OVER w = 7)
SELECT key, round(avg(((2 * (a / 49) * (b / 49) + 6.5025::DOUBLE) * (2 * (49 * ab - a * b) / 2352 + 58.5225::DOUBLE)) / ((pow(a / 49, 2) + pow(b / 49, 2) + 6.5025::DOUBLE) * ((49 * aa - a * a) / 2352 + (49 * bb - b * b) / 2352 + 58.5225::DOUBLE))), 9) AS similarity FROM v GROUP BY key"""


def resized_images(spark, d):
    """Embeddings as images of 4 pixels in a row with three channels, brought to sizes that the number of the vector tells."""
    rows = _pixels(spark, d).select("vec_id", (F.floor(F.size("p") / 12)).cast("int").alias("h"), F.lit(4).alias("w"), "p").filter("h > 0")
    lines = rows.select("vec_id", "w", "h", F.explode(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.struct(y.alias("y"), F.slice("p", y * 12 + 1, F.lit(12)).alias("pixels")))).alias("r")).select("vec_id", "w", "h", "r.*")
    made = geometry.resize(lines, "vec_id", "w", "h", F.pmod("vec_id", F.lit(9)).cast("int") + 1, F.pmod("vec_id", F.lit(7)).cast("int") + 2)
    return made.select("vec_id", F.col("y").cast("long").alias("y"), F.array_join("pixels", " ").alias("pixels"))


def _axis(n: str, to: str, at: str) -> str:
    place = f"(({at} + 0.5::DOUBLE) * ({n}::DOUBLE / {to}) - 0.5::DOUBLE)"
    return f"least(greatest(floor({place})::BIGINT, 0), {n} - 1), CASE WHEN floor({place}) >= 0 AND floor({place}) < {n} - 1 THEN floor((1 - ({place} - floor({place}))) * 2048 + 0.5)::BIGINT ELSE 2048 END"


_RESIZED = f"""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: least(255, greatest(0, floor(v::DOUBLE * 400 + 128.5)))::BIGINT) AS p FROM embeddings WHERE len(embedding) >= 12),
s AS (SELECT vec_id, p, len(p) // 12 AS h, vec_id % 9 + 1 AS w1, vec_id % 7 + 2 AS h1 FROM p),
o AS (SELECT *, unnest(range(w1 * 3)) AS xc FROM (SELECT *, unnest(range(h1)) AS y FROM s)),
a AS (SELECT vec_id, p, h, y, xc, xc % 3 AS c, [{_axis("4", "w1", "(xc // 3)")}] AS xa, [{_axis("h", "h1", "y")}] AS ya FROM o),
m AS (SELECT *, lambda_at FROM (SELECT vec_id, y, xc, xa[2] AS wx, ya[2] AS wy,
  p[ya[1] * 12 + xa[1] * 3 + c + 1] AS aa, p[ya[1] * 12 + least(xa[1] + 1, 3) * 3 + c + 1] AS ab, p[least(ya[1] + 1, h - 1) * 12 + xa[1] * 3 + c + 1] AS ba, p[least(ya[1] + 1, h - 1) * 12 + least(xa[1] + 1, 3) * 3 + c + 1] AS bb, true AS lambda_at FROM a))
SELECT vec_id, y, string_agg(least(255, greatest(0, ((aa * wx + ab * (2048 - wx)) * wy + (ba * wx + bb * (2048 - wx)) * (2048 - wy) + 2097152) >> 22))::VARCHAR, ' ' ORDER BY xc) AS pixels FROM m GROUP BY vec_id, y"""


def planned_batches(spark, d):
    """Eight documents of a source as the pages of one; lines are paragraphs, short ones titles and long ones running text."""
    label = F.when(F.length("line").between(3, 40), "title").when(F.length("line") > 60, "plain text")
    docs = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 8).alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    rows = docs.select("source", "doc", "page", F.col("ord").cast("long").alias("ord"), F.col("line").alias("text"), label.alias("label"), F.length("line").alias("top"))
    made = batching.plan_batches(rows, ["source", "doc"], "page", "ord")
    end = lambda k: F.element_at("items", k)
    return made.select("source", "doc", "seq", "kind", "tokens", F.size("items").cast("long").alias("n_items"), end(1)["page"].alias("first_page"), end(1)["ord"].alias("first_ord"), end(-1)["page"].alias("last_page"), end(-1)["ord"].alias("last_ord"), "title", "local_title")


_PLANNED = f"""
WITH RECURSIVE p AS (
  SELECT source, doc_id // 8 AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents
), r AS (SELECT *, length(line) AS top, {sql_words("line")} AS w, CASE WHEN length(line) BETWEEN 3 AND 40 THEN 'title' WHEN length(line) > 60 THEN 'plain text' END AS label, NOT ({_CID}) AND length(line) >= 5 AS ok, {_NUMERIC} OR ({_BARE}) AS no FROM p),
body AS (SELECT * FROM r WHERE ok AND label = 'plain text'),
e AS (SELECT source, doc, page, count(*) AS n, min(ord) AS a, max(ord) AS z FROM body GROUP BY ALL),
g AS (SELECT s.source, s.doc, s.page, coalesce(n, 0) AS n, a, z, row_number() OVER (PARTITION BY s.source, s.doc ORDER BY s.page) AS i FROM (SELECT DISTINCT source, doc, page FROM p) s LEFT JOIN e USING (source, doc, page)),
f AS (
  SELECT source, doc, i, page, n, z, false AS taken, NULL::BIGINT AS prev, NULL::BIGINT AS prev_z, NULL::BIGINT AS a FROM g WHERE i = 1
  UNION ALL
  SELECT g.source, g.doc, g.i, g.page, g.n, g.z, (f.n - f.taken::INT) >= 1 AND g.n >= 1, f.page, f.z, g.a FROM f JOIN g ON g.source = f.source AND g.doc = f.doc AND g.i = f.i + 1
), across AS (SELECT source, doc, prev AS page_a, prev_z AS ord_a, page AS page_b, a AS ord_b FROM f WHERE taken),
used1 AS (SELECT source, doc, page_a AS page, ord_a AS ord FROM across UNION SELECT source, doc, page_b, ord_b FROM across),
k AS (SELECT *, row_number() OVER o AS i, lead(top) OVER o - top > 20 AS up, lead(ord) OVER o AS mate FROM body ANTI JOIN used1 USING (source, doc, page, ord) WINDOW o AS (PARTITION BY source, doc, page ORDER BY ord)),
c AS (
  SELECT source, doc, page, ord, mate, i, coalesce(up, false) AS pairs FROM k WHERE i = 1
  UNION ALL
  SELECT k.source, k.doc, k.page, k.ord, k.mate, k.i, NOT c.pairs AND coalesce(k.up, false) FROM c JOIN k ON k.page = c.page AND k.source = c.source AND k.doc = c.doc AND k.i = c.i + 1
), cols AS (SELECT * FROM c WHERE pairs),
used AS (SELECT * FROM used1 UNION SELECT source, doc, page, ord FROM cols UNION SELECT source, doc, page, mate FROM cols),
rest AS (SELECT *, row_number() OVER (PARTITION BY source, doc, page ORDER BY ord) AS i, last_value(CASE WHEN label = 'title' THEN line END IGNORE NULLS) OVER (PARTITION BY source, doc ORDER BY page, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS recent FROM r ANTI JOIN used USING (source, doc, page, ord) WHERE ok AND NOT no),
pk AS (
  SELECT source, doc, page, i, ord, w, recent, 0::BIGINT AS batch, w AS t, 1::BIGINT AS n FROM rest WHERE i = 1
  UNION ALL
  SELECT k.source, k.doc, k.page, k.i, k.ord, k.w, k.recent, CASE WHEN f.t > 200 OR f.n > 5 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.t > 200 OR f.n > 5 THEN k.w ELSE f.t + k.w END, CASE WHEN f.t > 200 OR f.n > 5 THEN 1 ELSE f.n + 1 END
  FROM pk f JOIN rest k ON k.page = f.page AND k.source = f.source AND k.doc = f.doc AND k.i = f.i + 1
), made AS (
  SELECT x.source, x.doc, 0 AS pass, 'pages' AS kind, a.w + b.w AS tokens, 2::BIGINT AS n_items, page_a AS first_page, ord_a AS first_ord, page_b AS last_page, ord_b AS last_ord, NULL::VARCHAR AS recent FROM across x JOIN r a ON a.page = page_a AND a.ord = ord_a JOIN r b ON b.page = page_b AND b.ord = ord_b
  UNION ALL SELECT x.source, x.doc, 1, 'columns', a.w + b.w, 2, x.page, x.ord, x.page, mate, NULL::VARCHAR FROM cols x JOIN r a ON a.page = x.page AND a.ord = x.ord JOIN r b ON b.page = x.page AND b.ord = mate
  UNION ALL SELECT source, doc, 2, 'page', sum(w)::BIGINT, count(*), page, min(ord), page, max(ord), arg_max(coalesce(recent, ''), ord) FROM pk GROUP BY source, doc, page, batch
), first AS (SELECT source, doc, arg_min(line, page * 100000 + ord) AS title FROM r WHERE label = 'title' GROUP BY source, doc)
SELECT source, doc, row_number() OVER (PARTITION BY source, doc ORDER BY pass, first_page, first_ord) - 1 AS seq, kind, tokens, n_items, first_page, first_ord, last_page, last_ord, title, coalesce(nullif(recent, ''), title) AS local_title FROM made LEFT JOIN first USING (source, doc)"""

def verified_documents(spark, d):
    """Orders as documents and their line items as pages; some dual pages are missing or of other sizes."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    k = F.col("o_orderkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.row_number().over(at).alias("page"), "l_quantity", "l_returnflag")
    n = li.groupBy("o_orderkey").agg(F.count("*").alias("n"))
    docs = table(spark, d, "orders").join(n, "o_orderkey").select("o_orderkey", (F.col("n") + F.when(k % 11 == 0, 1).otherwise(0)).alias("pages"), (k % 2 == 0).alias("side_by_side"), (k % 5 > 0).alias("with_dual"), F.floor(F.col("o_totalprice") / 50).alias("bytes"))
    w = F.col("l_quantity") + 500
    mono = li.select("o_orderkey", "page", (k % 7 == 0).alias("written"), F.when(F.col("l_returnflag") == "R", "no").otherwise("有").alias("text"), w.alias("width"), F.lit(800.0).alias("height"), F.lit(800.0).alias("shown_width"), w.alias("shown_height"))
    copies = F.when(k % 2 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    dual = li.filter((k % 13 > 0) | (F.col("page") > 1)).select("o_orderkey", F.col("page").alias("p"), "l_returnflag", w.alias("w"), F.explode(copies).alias("c"))
    off = F.when(F.col("l_returnflag") == "A", 1.5).otherwise(0.5)
    dual = dual.select("o_orderkey", F.when(k % 2 == 0, F.col("p")).otherwise(2 * F.col("p") - 1 + F.col("c")).alias("page"), (F.col("w") + off).alias("width"), F.lit(800.0).alias("height"), (1600 + 2 * off).alias("shown_width"), F.col("w").alias("shown_height"))
    got = segments.verify_documents(docs, mono, dual, "o_orderkey")
    return got.select("o_orderkey", "failure", "mono_pages", "dual_pages", "size_mismatches", F.array_join(F.col("unwritten").cast("array<string>"), ",").alias("unwritten"))


_VERIFIED = """
WITH li AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS page, l_returnflag AS f FROM lineitem),
m AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE f = 'A') AS a, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE k % 7 = 0 AND f = 'R'), '') AS unwritten, count(*) FILTER (WHERE k % 13 > 0 OR page > 1) AS d, count(*) FILTER (WHERE (k % 13 > 0 OR page > 1) AND f = 'A') AS bad FROM li GROUP BY k),
x AS (SELECT o_orderkey, m.*, n + (k % 11 = 0)::INT AS pages, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS times FROM orders JOIN m ON k = o_orderkey)
SELECT x.o_orderkey, CASE WHEN n <> pages THEN 'pages' WHEN unwritten <> '' THEN 'unwritten' WHEN k % 5 > 0 AND d * times <> pages * times THEN 'dual pages' WHEN floor(o_totalprice / 50) <= 1024 THEN 'bytes' END AS failure,
  n AS mono_pages, CASE WHEN k % 5 > 0 THEN d * times END AS dual_pages, CASE WHEN k % 5 > 0 THEN bad * times ELSE 0 END AS size_mismatches, unwritten FROM x JOIN orders USING (o_orderkey)"""

QUERIES = {
    "verified_documents": (verified_documents, _VERIFIED),
    "separated_overlaps": (separated_overlaps, separated_sql("page")),
    "separated_streams": (separated_streams, separated_sql("page, name")),
    "operator_path_matches": (operator_path_matches, _PATH_MATCHES),
    "page_similarity": (page_similarity, _SIMILARITY),
    "resized_images": (resized_images, _RESIZED),
    "planned_batches": (planned_batches, _PLANNED),
}
