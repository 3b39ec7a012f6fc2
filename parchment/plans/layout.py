"""Named queries over boxes on pages; line items of an order stand for the boxes of a page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.functions import numbers
from parchment.operators import batching, layout
from parchment.plans.base import table

_SIZE = 120


def boxes(spark, d):
    li = table(spark, d, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    x0, y0 = F.pmod("l_partkey", F.lit(90)).cast("double"), F.pmod("l_suppkey", F.lit(80)).cast("double")
    name = F.when(F.col("l_returnflag") == "A", "figure").otherwise("plain text")
    return li.select(F.col("l_orderkey").alias("page"), (at - 1).alias("box_idx"), name.alias("name"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + F.col("l_quantity") / 2 + 1).alias("y1"), F.lit(_SIZE).alias("page_w"), F.lit(_SIZE).alias("page_h"))


BOXES = f"""b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS box_idx,
  CASE WHEN l_returnflag = 'A' THEN 'figure' ELSE 'plain text' END AS name, (l_partkey % 90)::DOUBLE AS x0, (l_suppkey % 80)::DOUBLE AS y0, l_partkey % 90 + l_quantity AS x1, l_suppkey % 80 + l_quantity / 2 + 1 AS y1, {_SIZE} AS page_w, {_SIZE} AS page_h FROM lineitem)"""


def box_class(spark, d):
    b = boxes(spark, d)
    chars = b.select("page", F.col("box_idx").cast("long").alias("char_id"), F.col("x1").alias("x"), (F.col("page_h") - F.col("y0") - 2).alias("y"), "page_w", "page_h")
    return layout.box_classes(chars, b, ["page"])


def coverage_share(spark, d):
    return layout.coverage(boxes(spark, d), ["page"])


def nearest_right(spark, d):
    return layout.nearest_right(boxes(spark, d), ["page"], "box_idx").select("page", F.col("box_idx").cast("long").alias("box_idx"), "max_x")


def nearest_below(spark, d):
    return layout.nearest_below(boxes(spark, d), ["page"], "box_idx", 5.0).select("page", F.col("box_idx").cast("long").alias("box_idx"), "min_y")


def overlap_pairs(spark, d):
    return layout.overlapping_pairs(boxes(spark, d), ["page"], "box_idx").select("page", F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"), "height", "width")


def lifted_boxes(spark, d):
    return layout.touching_below(boxes(spark, d), ["page"], "box_idx").select("page", F.col("box_idx").cast("long").alias("box_idx"), "lifted")


def separated_overlaps(spark, d):
    return layout.separate_overlaps(boxes(spark, d).withColumn("box_idx", F.col("box_idx").cast("long")), "page", "box_idx")


def scale_cap_mode(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_discount").alias("scale"), F.col("l_linenumber").cast("long").alias("w"))
    return layout.scale_cap(s, ["l_suppkey"], "scale", "w").groupBy("l_suppkey").agg(F.max("cap").alias("cap"), F.count_if(F.col("capped") < F.col("scale")).alias("cut"))


def second_gap(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity") / 10).alias("gaps"))
    return g.select("l_orderkey", layout.second_gap(F.col("gaps")).alias("gap"))


def scan_vote(spark, d):
    e = table(spark, d, "events").withColumn("group", F.floor(F.col("event_id") / 12))
    return layout.scan_vote(e, ["group"], "event_id", F.col("event_type") != "error").select("group", "total", "checked", "scanned_pages", "scanned")


def style_runs(spark, d):
    chars = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("ord"), F.col("l_returnflag").alias("font"), (F.when(F.col("l_quantity") > 45, 12.0).otherwise(10.0) + F.pmod("l_orderkey", F.lit(4)) * 0.0078125).alias("size"), F.lit(None).cast("string").alias("gstate"), F.lit("char").alias("kind")).repartition("l_suppkey")
    chars = chars.groupBy("l_suppkey", "ord", "gstate", "kind").agg(F.min("font").alias("font"), F.min("size").alias("size"))
    return batching.style_runs(chars, ["l_suppkey"], "ord").select("l_suppkey", F.col("run").cast("long").alias("run"), "first", "last", "font", "size", "n")


def matrices(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"), F.max("l_linenumber").cast("double").alias("k"))
    m = [F.col("n"), F.lit(0.5), F.lit(-0.5), F.col("k"), F.col("q"), F.lit(3.0)]
    page = numbers.page_matrix(F.pmod("l_orderkey", F.lit(4)) * 90, F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(800.0))
    both = numbers.multiply(m, [F.get(page, F.lit(i)) for i in range(6)])
    box = numbers.corner_box(both, F.lit(10.0), F.lit(2.0))
    return li.select("l_orderkey", box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), box["y1"].alias("y1"), F.round(box["angle"], 9).alias("angle"))


def unscaled_boxes(spark, d):
    b = boxes(spark, d).filter(F.col("x1") > 25)
    return b.select("page", F.col("box_idx").cast("long").alias("box_idx"), numbers.unscale(F.col("x0") * 10, F.lit(1024.0), F.lit(800.0), F.lit(612.0), F.lit(792.0)).alias("x"), numbers.bankers_round(F.col("y1")).alias("y"))


def text_layer_gate(spark, d):
    """Sources whose texts are short in sum and on average, as scanned documents have them."""
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean"))
    return g.select("source", "lang", ((F.col("chars") < 20_000) & (F.col("mean") < 2_500)).alias("scanned"))


def sampled_pages(spark, d):
    """Up to eight lines of each document: the first three and evenly spaced ones."""
    n = F.size(F.split("text", "\n", -1))
    spread = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: numbers.round_half_up(i * (n - 1) / 6).cast("int"))
    picked = F.when(n <= 8, F.sequence(F.lit(0), n - 1)).otherwise(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(1), F.lit(2)), spread))))
    return table(spark, d, "documents").select("doc_id", F.array_join(picked.cast("array<string>"), ",").alias("lines"))


_CELL = "least(greatest(trunc(%s)::BIGINT, 0), 119)"
_TOUCH = "o.box_idx <> a.box_idx AND o.x0 <= a.x1 AND o.x1 >= a.x0 AND o.y0 <= a.y0 AND o.y1 >= a.y0 - a.gap"

QUERIES = {
    "box_class": (box_class, f"""WITH {BOXES}, r AS (SELECT page, CASE WHEN name = 'figure' THEN 1000000 ELSE box_idx END AS rank, CASE WHEN name = 'figure' THEN 0 ELSE box_idx + 2 END AS cls, {_CELL % '(x0 - 1)'} AS l, {_CELL % '(120 - y1 - 1)'} AS bt, {_CELL % '(x1 + 1)'} AS rt, {_CELL % '(120 - y0 + 1)'} AS tp FROM b),
c AS (SELECT page, box_idx AS char_id, {_CELL % 'x1'} AS x, {_CELL % '(120 - y0 - 2)'} AS y FROM b) SELECT c.page, c.char_id, coalesce(arg_max(cls, rank), 1)::BIGINT AS cls FROM c LEFT JOIN r ON r.page = c.page AND x >= l AND x < rt AND y >= bt AND y < tp GROUP BY ALL"""),
    "coverage_share": (coverage_share, f"WITH {BOXES}, g AS (SELECT x, y FROM range(64) t(x), range(64) s(y)) SELECT page, count(DISTINCT CASE WHEN x IS NOT NULL THEN x * 64 + y END) / 4096 AS coverage FROM b LEFT JOIN g ON (x + 0.5::DOUBLE) * (120 / 64) BETWEEN x0 AND x1 AND (y + 0.5::DOUBLE) * (120 / 64) BETWEEN y0 AND y1 GROUP BY page"),
    "nearest_right": (nearest_right, f"WITH {BOXES} SELECT a.page, a.box_idx, min(least(a.page_w::DOUBLE, coalesce(o.x0, a.page_w::DOUBLE))) AS max_x FROM b a LEFT JOIN b o ON a.page = o.page AND o.x0 > a.x0 AND NOT (o.y0 >= a.y1 OR o.y1 <= a.y0) GROUP BY a.page, a.box_idx"),
    "nearest_below": (nearest_below, f"WITH {BOXES} SELECT a.page, a.box_idx, max(greatest(5.0::DOUBLE, coalesce(o.y1, 5.0::DOUBLE))) AS min_y FROM b a LEFT JOIN b o ON a.page = o.page AND o.y1 < a.y0 AND NOT (o.x0 >= a.x1 OR o.x1 <= a.x0) GROUP BY a.page, a.box_idx"),
    "overlap_pairs": (overlap_pairs, f"WITH {BOXES} SELECT a.page, a.box_idx AS first, o.box_idx AS second, least(a.y1, o.y1) - greatest(a.y0, o.y0) AS height, least(a.x1, o.x1) - greatest(a.x0, o.x0) AS width FROM b a JOIN b o ON a.page = o.page AND a.box_idx < o.box_idx AND a.x0 < o.x1 AND a.x1 > o.x0 AND a.y0 < o.y1 AND a.y1 > o.y0 AND NOT ((a.y0 >= o.y0 AND a.y1 <= o.y1) OR (o.y0 >= a.y0 AND o.y1 <= a.y1))"),
    "lifted_boxes": (lifted_boxes, f"WITH {BOXES}, g AS (SELECT *, CASE WHEN y1 - y0 < 36 THEN 0.5::DOUBLE ELSE 3.0::DOUBLE END AS gap FROM b), t AS (SELECT a.page, a.box_idx, any_value(a.y0) AS y0, any_value(a.y1) AS y1, max(o.y1) + any_value(a.gap) AS moved FROM g a LEFT JOIN b o ON a.page = o.page AND {_TOUCH} GROUP BY a.page, a.box_idx) SELECT page, box_idx, CASE WHEN moved < y1 THEN moved ELSE y0 END AS lifted FROM t"),
    "scale_cap_mode": (scale_cap_mode, "WITH s AS (SELECT l_suppkey, l_discount AS scale, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), c AS (SELECT l_suppkey, scale AS cap FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, scale) = 1) SELECT l_suppkey, max(cap) AS cap, count_if(l_discount > cap)::BIGINT AS cut FROM lineitem JOIN c USING (l_suppkey) GROUP BY l_suppkey"),
    "second_gap": (second_gap, "WITH g AS (SELECT l_orderkey, list_sort(list_distinct(list(l_quantity / 10) FILTER (WHERE l_quantity / 10 > 1))) AS g FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN coalesce(len(g), 0) = 0 THEN 1.0::DOUBLE WHEN len(g) = 1 THEN g[1] ELSE g[2] END AS gap FROM g"),
    "scan_vote": (scan_vote, "WITH v AS (SELECT event_id // 12 AS \"group\", event_id, (event_type <> 'error')::INT AS yes FROM events), r AS (SELECT *, count(*) OVER g AS n, coalesce(sum(yes) OVER w, 0) AS y, coalesce(sum(1 - yes) OVER w, 0) AS no FROM v WINDOW g AS (PARTITION BY \"group\"), w AS (PARTITION BY \"group\" ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), t AS (SELECT *, greatest(n * 0.8::DOUBLE, 1) AS t FROM r), k AS (SELECT *, y < t AND no < n - t AS seen FROM t) SELECT \"group\", max(n) AS total, count_if(seen)::BIGINT AS checked, sum(CASE WHEN seen THEN yes ELSE 0 END)::BIGINT AS scanned_pages, sum(CASE WHEN seen THEN yes ELSE 0 END) >= max(t) AS scanned FROM k GROUP BY \"group\""),
    "style_runs": (style_runs, """WITH RECURSIVE c AS (SELECT l_suppkey, l_orderkey * 1000 + l_partkey AS ord, min(l_returnflag) AS font, min(CASE WHEN l_quantity > 45 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END + (l_orderkey % 4) * 0.0078125::DOUBLE) AS size FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ord) AS i FROM c), r AS (
  SELECT l_suppkey, i, ord, font, size, font AS head, size AS head_size, 1::BIGINT AS run FROM n WHERE i = 1
  UNION ALL
  SELECT l_suppkey, i, ord, font, size, CASE WHEN same THEN head ELSE font END, CASE WHEN same THEN head_size ELSE size END, run + (NOT same)::BIGINT
  FROM (SELECT n.*, r.head, r.head_size, r.run, n.font = r.head AND abs(n.size - r.head_size) < 0.02::DOUBLE AS same FROM r JOIN n ON n.l_suppkey = r.l_suppkey AND n.i = r.i + 1)
) SELECT l_suppkey, run, min(ord) AS first, max(ord) AS last, arg_min(font, ord) AS font, arg_min(size, ord) AS size, count(*) AS n FROM r GROUP BY l_suppkey, run"""),
    "matrices": (matrices, """WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*)::DOUBLE AS n, max(l_linenumber)::DOUBLE AS k, l_orderkey % 4 AS r FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, CASE r WHEN 1 THEN [0, -1, 1, 0, 0, 600] WHEN 2 THEN [-1, 0, 0, -1, 600, 800] WHEN 3 THEN [0, 1, -1, 0, 800, 0] ELSE [1, 0, 0, 1, 0, 0] END::DOUBLE[] AS p FROM o),
x AS (SELECT l_orderkey, n * p[1] + 0.5::DOUBLE * p[3] AS a, n * p[2] + 0.5::DOUBLE * p[4] AS b, -0.5::DOUBLE * p[1] + k * p[3] AS c, -0.5::DOUBLE * p[2] + k * p[4] AS d, q * p[1] + 3 * p[3] + p[5] AS e, q * p[2] + 3 * p[4] + p[6] AS f FROM m)
SELECT l_orderkey, least(e, 2 * c + e, 10 * a + e, 10 * a + 2 * c + e) AS x0, least(f, 2 * d + f, 10 * b + f, 10 * b + 2 * d + f) AS y0, greatest(e, 2 * c + e, 10 * a + e, 10 * a + 2 * c + e) AS x1, greatest(f, 2 * d + f, 10 * b + f, 10 * b + 2 * d + f) AS y1, round(degrees(atan2(b, a)), 9) AS angle FROM x"""),
    "unscaled_boxes": (unscaled_boxes, f"WITH {BOXES}, g AS (SELECT least(1024.0::DOUBLE / 612, 800.0::DOUBLE / 792) AS gain) SELECT page, box_idx, ((x0 * 10 - round_even((1024 - 612 * gain) / 2 - 0.1::DOUBLE, 0)) / gain)::FLOAT AS x, round_even(y1, 0) AS y FROM b, g WHERE x1 > 25"),
    "sampled_pages": (sampled_pages, "WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 8 THEN array_to_string(range(n), ',') ELSE array_to_string(list_sort(list_distinct([0, 1, 2] || list_transform(range(1, 6), lambda i: floor(i * (n - 1) / 6 + 0.5::DOUBLE)::BIGINT))), ',') END AS lines FROM n"),
    "text_layer_gate": (text_layer_gate, "SELECT source, lang, sum(n_chars) < 20000 AND avg(n_chars) < 2500 AS scanned FROM documents GROUP BY source, lang"),
}
