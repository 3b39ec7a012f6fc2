"""Characters on pages: segments, runs and how drawn text lines up with its operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.operators import geometry
from parchment.operators.machines import fold
from parchment.sources.scratch import written

#: Points within which two starts are the same, and the share of starts that must be.
NEAR, AGREEMENT = 1.0, 0.95


def segments(chars: DataFrame, by: list[str], order: str, width: Column) -> DataFrame:
    """Characters (x0, x1, size, cls) cut into segments: where the class changes, or text jumps back by over a quarter of the width.

    One row for each segment: its bounds in order, its box and how many characters it has.
    """
    w = Window.partitionBy(*by).orderBy(order)
    cut = (F.col("cls") != F.lag("cls").over(w)) | (F.lag("x1").over(w) - F.col("x0") > width / 4)
    marked = chars.withColumn("__cut", F.coalesce(cut, F.lit(True)).cast("int"))
    marked = marked.withColumn("segment", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def base_style(chars: DataFrame, by: list[str], order: str) -> DataFrame:
    """The font and the size that most characters of a group have, of equally frequent ones that seen first."""
    out = None
    for what in ("font", "size"):
        counted = chars.groupBy(*by, what).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
        best = counted.groupBy(*by).agg(F.max_by(what, F.struct(F.col("__n"), -F.col("__first"))).alias(what))
        out = best if out is None else out.join(best, by)
    return out


def merged_style(chars: DataFrame, by: list[str], order: str, slack: float = 0.02) -> DataFrame:
    """The style (font, size, gstate) that a group's characters share.

    Styles merge one after another: what differs (sizes by slack or more) is open, and a merged style of open size gives way to the next
    character's. Of what is open at the end, font and size are those that most characters have (base_style), gstate is null.
    """

    def step(s: dict, c: tuple) -> tuple:
        if s["size"] is None:
            s.update(font=c.font, size=c.size, gstate=c.gstate)
        elif c.size is not None:
            s.update(font=s["font"] if s["font"] == c.font else None, size=s["size"] if abs(s["size"] - c.size) < slack else None, gstate=s["gstate"] if s["gstate"] == c.gstate else None)
        return s["font"], s["size"], s["gstate"]

    rows = chars.select(*by, order, "font", "size", "gstate")
    merged = fold(rows, by, [order], lambda: {"font": None, "size": None, "gstate": None}, step, "font string, size double, gstate string")
    last = merged.groupBy(*by).agg(F.max_by(F.struct("font", "size", "gstate"), order).alias("last"))
    most = base_style(chars, by, order).withColumnsRenamed({"font": "most_font", "size": "most_size"})
    return last.join(most, by).select(*by, F.coalesce("last.font", "most_font").alias("font"), F.coalesce("last.size", "most_size").alias("size"), F.col("last.gstate").alias("gstate"))


def glyph_runs(glyphs: DataFrame, by: list[str], order: str, slack: float = 0.5) -> DataFrame:
    """Glyphs (text, x0, x1, y, font, size) merged into runs of one font, size and base line that leave no gap in between."""
    w = Window.partitionBy(*by).orderBy(order)
    goes_on = F.lag("font").over(w).eqNullSafe(F.col("font")) & (F.lag("size").over(w) == F.col("size")) & (F.lag("y").over(w) == F.col("y")) & (F.abs(F.col("x0") - F.lag("x1").over(w)) <= slack)
    marked = glyphs.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda g: g["text"]), "")
    return marked.groupBy(*by, "run").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def agreement(firsts: DataFrame, operators: DataFrame, by: list[str]) -> DataFrame:
    """For each page, whether glyphs and operators of equal numbers belong together: forms all equal, starts near for 95 %.

    firsts has seq, path, x, y of the first glyph of each operator; operators seq, path, x, y.
    """
    near = F.hypot(F.col("o.x") - F.col("g.x"), F.col("o.y") - F.col("g.y")) <= NEAR
    met = firsts.alias("g").join(operators.alias("o"), [*(F.col(f"g.{b}") == F.col(f"o.{b}") for b in by), F.col("g.seq") == F.col("o.seq")], "left")
    same = F.coalesce(F.col("g.path") == F.col("o.path"), F.lit(False))
    return met.groupBy(*[F.col(f"g.{b}") for b in by]).agg(F.every(same).alias("same_path"), F.avg((same & near).cast("int")).alias("agree")).withColumn("trusted", F.col("same_path") & (F.col("agree") >= AGREEMENT))


def match_in_order(firsts: DataFrame, operators: DataFrame, page: str, path: str | None = None) -> DataFrame:
    """Each glyph start with the next operator of its page, and of its path of forms if that is given, that is near it: see geometry.match_in_order."""
    return geometry.match_in_order(firsts, operators, [page, *([path] if path else [])], NEAR)


def descend(nodes: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """depth of each node under the roots (null parents), level by level; nodes of a cycle have none and are left out.

    Nodes of depth most or more are left out too: an outline is read 64 levels deep at most, which guards against cycles.
    """
    nodes = written(nodes.select(node, parent), "nodes")
    level = nodes.filter(F.col(parent).isNull()).select(node, F.lit(0).alias("depth"))
    found = level
    for depth in range(1, most):
        level = written(nodes.join(level.select(F.col(node).alias(parent)), parent).select(node, F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def verify_pages(expected: DataFrame, actual: DataFrame, page: list[str], slack: float = 1.0) -> DataFrame:
    """What is wrong with each page: missing, added, another size by more than slack, or null."""
    a, b = expected.alias("a"), actual.alias("b")
    met = a.join(b, page, "full")
    size = (F.abs(F.col("a.width") - F.col("b.width")) > slack) | (F.abs(F.col("a.height") - F.col("b.height")) > slack)
    return met.select(*page, F.when(F.col("b.width").isNull(), "missing").when(F.col("a.width").isNull(), "added").when(size, "size").alias("wrong"))


#: Characters of which a page that was written must have one, the slack of sizes, and the bytes that a file has more than.
WRITTEN, LEAST_BYTES = "[\\x{4E00}-\\x{9FFF}]", 1024


def verify_documents(docs: DataFrame, mono: DataFrame, dual: DataFrame, by: str) -> DataFrame:
    """What is wrong with documents that were written: by, failure, mono_pages, dual_pages, size_mismatches and unwritten.

    docs has pages, side_by_side, with_dual and bytes; mono a row for each page (from 1): written, text, width, height, and shown_width, shown_height as it is
    displayed; dual page, width, height, shown_width and shown_height. failure is the first of: "pages" (another number than docs says),
    "unwritten" (written pages without a Chinese character, their numbers in unwritten), "dual pages" (as many pages side by side, or else twice as many), "bytes" (1,024 or
    less), or null. size_mismatches counts pages of the dual document: side by side, those that aren't as displayed and twice as wide (to 2), or as high (to 1);
    else each page that differs by over 1 from the mono page it belongs to. It fails nothing.
    """
    page = mono.groupBy(by).agg(
        F.count("*").alias("mono_pages"), F.array_sort(F.collect_list(F.when(F.col("written") & ~F.coalesce(F.col("text"), F.lit("")).rlike(WRITTEN), F.col("page")))).alias("unwritten")
    )
    kinds = docs.select(by, "side_by_side")
    placed = dual.join(kinds, by).withColumn("of", F.when(F.col("side_by_side"), F.col("page")).otherwise(F.floor((F.col("page") + 1) / 2).cast("int"))).alias("d")
    m, d = (lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0.0))), (lambda c: F.col(f"d.{c}"))
    met = placed.join(mono.alias("m"), (F.col(f"d.{by}") == F.col(f"m.{by}")) & (F.col("d.of") == F.col("m.page")), "left")
    beside = (F.abs(d("shown_width") - 2 * m("shown_width")) > 2) | (F.abs(d("shown_height") - m("shown_height")) > 1)
    apart = (F.abs(d("width") - m("width")) > 1) | (F.abs(d("height") - m("height")) > 1)
    sizes = met.groupBy(F.col(f"d.{by}").alias(by)).agg(F.count("*").alias("dual_pages"), F.count_if(F.when(d("side_by_side"), beside).otherwise(apart)).alias("size_mismatches"))
    all_of = docs.join(page, by, "left").join(sizes, by, "left").fillna(0, ["mono_pages", "dual_pages", "size_mismatches"])
    want = F.when(F.col("side_by_side"), F.col("pages")).otherwise(F.col("pages") * 2)
    failure = F.when(F.col("mono_pages") != F.col("pages"), "pages").when(F.size("unwritten") > 0, "unwritten").when(F.col("with_dual") & (F.col("dual_pages") != want), "dual pages").when(F.col("bytes") <= LEAST_BYTES, "bytes")
    return all_of.select(by, failure.alias("failure"), "mono_pages", F.when(F.col("with_dual"), F.col("dual_pages")).alias("dual_pages"), F.when(F.col("with_dual"), F.col("size_mismatches")).otherwise(F.lit(0)).cast("long").alias("size_mismatches"), F.coalesce("unwritten", F.array().cast("array<int>")).alias("unwritten"))
