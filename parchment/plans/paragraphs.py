"""Named queries over paragraphs and formulas of pages, with the whole state of segmentation in their SQL; and over maps of fonts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import text
from parchment.operators import fonts
from parchment.operators import paragraphs as P
from parchment.plans.base import table

_SIGNS = ["a", "b", "T", "(", "x", ")", " ", "•", "α", "=", "y", "z"]


def _marked(spark, d):
    """Line items of a supplier as the characters of a page 800 wide, in order of their orders; boxes change every few thousand orders."""
    order = F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", order.alias("ord")).agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("p"), F.min("l_linestatus").alias("gstate"))
    sign = F.element_at(F.array(*map(F.lit, _SIGNS)), (F.col("p") % 12 + 1).cast("int"))
    x, y = F.pmod("l_orderkey", F.lit(4000)) / 8, F.col("p") % 3 + 700.0
    size = F.when(F.col("q") > 45, 12.0).when(F.col("q") < 8, 7.0).otherwise(10.0)
    cls = F.when(F.col("q") % 16 == 15, 0).otherwise(F.expr("l_orderkey div 8192") % 3 + 2).cast("int")
    chars = li.select("l_suppkey", "ord", sign.alias("text"), x.alias("x0"), y.alias("y0"), (x + 5).alias("x1"), (y + size).alias("y1"), size.alias("size"), cls.alias("cls"), "gstate", (F.col("q") == 44).alias("line"))
    return P.mark_characters(chars.withColumn("formula", P.looks_like_formula(F.col("text"), F.lit(False), F.lit(False))), ["l_suppkey"], "ord", 800.0)


def page_paragraphs(spark, d):
    return P.paragraphs(_marked(spark, d), ["l_suppkey"], "ord")


def page_formulas(spark, d):
    return P.formulas(_marked(spark, d), ["l_suppkey"], "ord")


def inlined_lengths(spark, d):
    """Orders as files of two numbers and one reference, which may be to neither; five digits fit into its place."""
    k = F.col("o_orderkey")
    source = F.concat(F.lit("0 0 obj 77 endobj "), (k % 3).cast("string"), F.lit(" 0 obj\n"), (k * 7).cast("string"), F.lit("\nendobj << /Length "), (k % 4).cast("string"), F.lit(" 0 R >> stream"))
    return table(spark, d, "orders").select("o_orderkey", text.inline_lengths(source).alias("source"))


def unicode_maps(spark, d):
    """Forty parts are a font, whose map says something of a few codes for each of them, in one of four kinds of blocks."""
    h = lambda n: F.concat(F.lit("<"), F.lpad(F.hex(n), 4, "0"), F.lit(">"))
    p = F.col("p_partkey")
    code, sign = p % 61, F.when(p % 7 == 0, 160).when(p % 5 == 0, 32).otherwise(p % 90 + 34)
    block = F.when(p % 4 == 0, F.concat(F.lit("1 beginbfchar "), h(code), h(sign), F.lit(" endbfchar")))
    block = block.when(p % 4 == 1, F.concat(F.lit("1 beginbfrange "), h(code), h(code + 3), h(sign), F.lit(" endbfrange")))
    block = block.when(p % 4 == 2, F.concat(F.lit("1 beginbfrange "), h(code), h(code + 2), F.lit(" ["), h(sign), h(sign + 7), F.lit("] endbfrange")))
    block = block.otherwise(F.concat(F.lit("1 begincidrange "), h(sign), h(sign + 2), code.cast("string"), F.lit(" endcidrange")))
    maps = table(spark, d, "part").groupBy(F.floor(p / 40).alias("font")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("block")))), lambda x: x["block"]), "\n").alias("cmap"))
    return fonts.unicode_maps(maps, ["font"], "cmap")


_STATES = """g AS (SELECT l_suppkey, l_orderkey, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber AS ord, min(l_quantity)::INT AS q, min(l_partkey) AS p, min(l_linestatus) AS gs FROM lineitem GROUP BY 1, 2, 3),
h AS (SELECT *, (['a', 'b', 'T', '(', 'x', ')', ' ', '•', 'α', '=', 'y', 'z'])[p % 12 + 1] AS t, (l_orderkey % 4000) / 8 AS cx, (p % 3 + 700)::DOUBLE AS cy, CASE WHEN q > 45 THEN 12 WHEN q < 8 THEN 7 ELSE 10 END::DOUBLE AS cs,
  CASE WHEN q % 16 = 15 THEN 0 ELSE l_orderkey // 8192 % 3 + 2 END AS cc, q = 44 AS ln FROM g),
c AS (SELECT l_suppkey, ord, t, cx, cy, cs, cc, gs, ln, row_number() OVER (PARTITION BY l_suppkey ORDER BY ord) AS n FROM h),
r AS (
  SELECT DISTINCT l_suppkey, 0::BIGINT AS i, 0::BIGINT AS at, -1::BIGINT AS para, -1::BIGINT AS cls, 0::DOUBLE AS x, 0::DOUBLE AS y, false AS was, 0::BIGINT AS held, 0::BIGINT AS brackets, '' AS txt, 0::DOUBLE AS size, 0::DOUBLE AS base,
    false AS brk, NULL::VARCHAR AS gstate, false AS styled, 0::BIGINT AS made, 0::DOUBLE AS low, 0::DOUBLE AS reach, 0::DOUBLE AS fix, NULL::BIGINT AS formula, false AS line, NULL::BIGINT AS shut, NULL::DOUBLE AS shut_fix, false AS blank FROM c
  UNION ALL
  SELECT l_suppkey, i + 1, ord, para2, CASE WHEN ln THEN cls ELSE k END, CASE WHEN ln THEN x ELSE cx END, CASE WHEN ln THEN y ELSE cy END, CASE WHEN ln THEN was ELSE f END, CASE WHEN ln THEN held WHEN f THEN held2 + 1 ELSE 0 END,
    CASE WHEN ln THEN brackets ELSE brackets + b END, CASE WHEN ln OR f THEN txt3 ELSE txt3 || t END, CASE WHEN grows THEN cs ELSE size2 END, CASE WHEN grows THEN base2 - (cs - size2) ELSE base2 END, brk2,
    CASE WHEN ln THEN gstate WHEN f THEN CASE WHEN fresh THEN NULL ELSE gstate END WHEN fresh OR NOT styled THEN gs WHEN gstate = gs THEN gs END, CASE WHEN ln THEN styled ELSE NOT f OR (styled AND NOT fresh) END, made2,
    CASE WHEN opens THEN cy ELSE low END, CASE WHEN opens THEN cx WHEN f AND NOT ln THEN greatest(reach, cx) ELSE reach END,
    CASE WHEN opens THEN CASE WHEN same2 AND cx > x THEN cy - y ELSE 0 END ELSE fix END, CASE WHEN ln THEN CASE WHEN held > 0 AND cc = cls THEN made END WHEN f THEN made2 END, ln,
    CASE WHEN closes THEN made END, CASE WHEN closes THEN CASE WHEN NOT f AND k = cls AND cx > reach THEN low - cy ELSE fix END END, t = ' '
  FROM (SELECT *, NOT ln AND f AND held2 = 0 AS opens, NOT ln AND NOT f AND t <> ' ' AND (cs > size2 OR len(trim(txt3)) = 1) AS grows
  FROM (SELECT *, txt2 || CASE WHEN spaced THEN ' ' ELSE '' END AS txt3, CASE WHEN fresh THEN cs ELSE size END AS size2, CASE WHEN fresh THEN cy ELSE base END AS base2, CASE WHEN fresh THEN false ELSE brk OR (spaced AND cx + 5 < x) END AS brk2
  FROM (SELECT *, para + fresh::BIGINT AS para2, CASE WHEN fresh THEN '' WHEN closes THEN txt || '{v' || made || '}' ELSE txt END AS txt2, NOT ln AND held2 = 0 AND NOT fresh AND (cx > x + 5 + 1 OR cx + 5 < x) AS spaced
  FROM (SELECT *, NOT ln AND held2 = 0 AND NOT same2 AS fresh FROM (SELECT *, CASE WHEN closes THEN 0 ELSE held END AS held2, made + closes::BIGINT AS made2, k = cls AND NOT (closes AND txt = '') AS same2
  FROM (SELECT *, NOT ln AND held > 0 AND (NOT f OR k <> cls OR (txt <> '' AND abs(cx - x) > 200)) AS closes
  FROM (SELECT *, CASE WHEN t = ' ' THEN was ELSE sure OR b <> 0 END AS f FROM (SELECT *, CASE WHEN ln OR sure THEN 0 WHEN t = '(' AND held > 0 THEN 1 WHEN t = ')' AND brackets > 0 THEN -1 ELSE 0 END AS b
  FROM (SELECT *, k = 0 OR t IN ('α', '=') OR (k = cls AND len(trim(txt)) > 1 AND cs < size * 0.79::DOUBLE) AS sure
  FROM (SELECT r.*, c.* EXCLUDE (l_suppkey), CASE WHEN t = ' ' AND para >= 0 THEN cls WHEN t = '•' THEN 0 ELSE cc END AS k FROM r JOIN c ON r.l_suppkey = c.l_suppkey AND c.n = r.i + 1)))))))))) )"""

QUERIES = {
    "inlined_lengths": (inlined_lengths, r"""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS name, o_orderkey % 4 AS meant, o_orderkey * 7 AS n FROM orders),
v AS (SELECT *, CASE WHEN meant = name THEN n WHEN meant = 0 THEN 77 END AS found FROM o)
SELECT o_orderkey, '0 0 obj 77 endobj ' || name || E' 0 obj\n' || n || E'\nendobj << ' || CASE WHEN found < 100000 THEN rpad('/Length ' || found, 13, ' ') ELSE '/Length ' || meant || ' 0 R' END || ' >> stream' AS source FROM v"""),
    "unicode_maps": (unicode_maps, """WITH p AS (SELECT p_partkey AS p, p_partkey // 40 AS font, p_partkey % 61 AS code, CASE WHEN p_partkey % 7 = 0 THEN 160 WHEN p_partkey % 5 = 0 THEN 32 ELSE p_partkey % 90 + 34 END AS sign FROM part),
s AS (SELECT font, p, code + k AS cid, sign + CASE WHEN p % 4 = 2 THEN k * 7 ELSE k END AS u FROM p, range(4) t(k) WHERE k < ([1, 4, 2, 3])[p % 4 + 1]),
f AS (SELECT font, cid, arg_max(u, p) AS last, arg_max(u, p) FILTER (WHERE u <> 160) AS other FROM s GROUP BY ALL)
SELECT font, cid, chr(CASE WHEN last = 160 AND other = 32 THEN 32 ELSE last END::INT) AS text FROM f"""),
    "page_paragraphs": (page_paragraphs, f"""WITH RECURSIVE {_STATES},
m AS (SELECT *, lead(para) OVER (PARTITION BY l_suppkey ORDER BY i) IS DISTINCT FROM para AS ends FROM r WHERE i > 0 AND NOT line),
b AS (SELECT l_suppkey, para, arg_min(c.cx, ord) AS x, min(CASE WHEN NOT blank THEN c.cx END) AS nx0, max(CASE WHEN NOT blank THEN c.cx + 5 END) AS nx1, min(CASE WHEN NOT blank THEN c.cy END) AS ny0, max(CASE WHEN NOT blank THEN c.cy + c.cs END) AS ny1,
  arg_min(c.cy, ord) AS fy0, arg_min(c.cy + c.cs, ord) AS fy1 FROM m JOIN c USING (l_suppkey) WHERE c.ord = m.at GROUP BY ALL)
SELECT l_suppkey, para, txt || CASE WHEN held > 0 THEN '{{v' || made || '}}' ELSE '' END AS text, b.x, base AS y, size, brk, gstate, least(b.x, nx0) AS x0, greatest(b.x, nx1) AS x1, least(fy0, ny0) AS y0, greatest(fy1, ny1) AS y1
FROM m JOIN b USING (l_suppkey, para) WHERE ends"""),
    "page_formulas": (page_formulas, f"""WITH RECURSIVE {_STATES},
e AS (SELECT l_suppkey, shut AS formula, any_value(shut_fix) AS shut_fix FROM r WHERE shut IS NOT NULL GROUP BY ALL),
f AS (SELECT r.l_suppkey, formula, max(CASE WHEN NOT line THEN para END) AS para, count_if(NOT line)::BIGINT AS chars, count_if(line)::BIGINT AS lines, max(CASE WHEN NOT line THEN cx + 5 END) - arg_min(cx, ord) FILTER (WHERE NOT line) AS len, arg_min(fix, ord) FILTER (WHERE NOT line) AS fix
  FROM r JOIN c ON r.l_suppkey = c.l_suppkey AND r.at = c.ord WHERE i > 0 AND formula IS NOT NULL GROUP BY ALL)
SELECT f.l_suppkey, f.formula, para, chars, lines, len, coalesce(shut_fix, fix) AS fix FROM f LEFT JOIN e ON f.l_suppkey = e.l_suppkey AND f.formula = e.formula"""),
}
