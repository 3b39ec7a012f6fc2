"""Paragraphs and formulas of a page, told apart character by character.

Characters are read in the order in which the page draws them. What one is depends on those before it through a state of a
few numbers, so a page may have any number of characters; texts and boxes are put together by grouping afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.predicates import is_formula_char
from parchment.operators.layout import second_gap
from parchment.operators.machines import fold

#: Smaller than this share of its paragraph's size, a character is a sub- or superscript.
SMALL = 0.79
#: What counts as a blank, alone or repeated.
BLANKS = r"^[\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{200B}\x{2060}\t]+$"

_OUT = "para long, formula long, piece string, x0 double, y0 double, x1 double, y1 double, blank boolean, line boolean, size double, y double, brk boolean, gstate string, fix double, shut long, shut_fix double"


def looks_like_formula(text: Column, formula_font: Column, vertical: Column) -> Column:
    """Whether a character by itself belongs to a formula: its sign, its font, or that it stands upright."""
    return F.coalesce(is_formula_char(text), F.lit(False)) | F.coalesce(formula_font, F.lit(False)) | F.coalesce(vertical, F.lit(False))


def _grow(s: dict, piece: str) -> None:
    """Append to the paragraph's text, of which only the length without outer blanks is kept."""
    if piece.isalnum():
        s["core"], s["tail"], s["empty"] = s["core"] + s["tail"] + len(piece), 0, False
        return
    s["empty"] = s["empty"] and not piece
    piece = piece if s["core"] else piece.lstrip()
    solid = piece.rstrip()
    if solid:
        s["core"] += s["tail"] + len(solid)
        s["tail"] = 0
    s["tail"] += len(piece) - len(solid)


def mark_characters(chars: DataFrame, by: list[str], order: str, width: float, strict: bool = False) -> DataFrame:
    """For each character its paragraph, its formula (null for text), and the piece that it adds to the paragraph's text.

    chars has text, x0, y0, x1, y1, size, cls (0: a box of the layout that is no text), formula (looks_like_formula), gstate, and
    line, which is true for a drawn line; order is unique in a group. A paragraph begins where the class changes. A formula has the
    characters of class 0, the bullets, those that look like formulas, those under 0.79 of the paragraph's size once it has
    two signs, and brackets that open within it; it ends with the first other one, or where the page jumps by over a quarter of
    its width. A gap of more than a point is a blank, and so is a return to the left, which also marks the paragraph as broken (brk). The
    first sign gives way to the second's size, and a larger sign raises the paragraph's. Blanks go along with what is before them,
    unless strict. A line belongs to the formula around it, if any. size, y, brk and gstate are the paragraph's so far; fix is how far the
    formula is raised, which the character that ends it may change (shut, shut_fix).
    """

    def start() -> dict:
        new = {"para": -1, "cls": -1, "formulas": 0, "held": 0, "brackets": 0, "core": 0, "tail": 0, "empty": True, "was": False, "brk": False, "styled": False, "gstate": None}
        return new | dict.fromkeys(("x0", "x1", "y0", "size", "y", "fix", "low", "reach"), 0.0)

    def belongs(s: dict, e: tuple, cls: int) -> bool:
        if e.text == " " and not strict:
            return s["was"]
        if cls == 0 or e.formula or (cls == s["cls"] and s["core"] > 1 and e.size < s["size"] * SMALL):
            return True
        if e.text == "(" and s["held"]:
            s["brackets"] += 1
            return True
        if e.text == ")" and s["brackets"]:
            s["brackets"] -= 1
            return True
        return False

    def step(s: dict, e: tuple) -> tuple:
        if e.line:
            inside = s["formulas"] if s["held"] and e.cls == s["cls"] else None
            return None, inside, None, e.x0, e.y0, e.x1, e.y1, False, True, None, None, None, None, None, None, None
        blank = e.text == " "
        cls = s["cls"] if blank and s["para"] >= 0 and not strict else 0 if e.text == "•" else e.cls
        formula = s["was"] = belongs(s, e, cls)
        goes_on, shut, piece = cls == s["cls"], (None, None), ""
        jumps = not s["empty"] and abs(e.x0 - s["x0"]) > width / 4
        if s["held"] and not (formula and goes_on and not jumps):
            lowered = not formula and goes_on and e.x0 > s["reach"]
            shut = s["formulas"], s["low"] - e.y0 if lowered else s["fix"]
            goes_on = goes_on and not s["empty"]
            _grow(s, f"{{v{s['formulas']}}}")
            s.update(held=0, fix=0.0, formulas=s["formulas"] + 1)
        if not s["held"]:
            if not goes_on:
                s.update(para=s["para"] + 1, size=e.size, y=e.y0, brk=False, styled=False, gstate=None, core=0, tail=0, empty=True)
            elif (returns := e.x1 < s["x0"]) or e.x0 > s["x1"] + 1:
                piece = " "
                s["brk"] = s["brk"] or (returns and not e.x0 > s["x1"] + 1)
                _grow(s, " ")
        if formula:
            if not s["held"]:
                piece += f"{{v{s['formulas']}}}"
                s.update(low=e.y0, reach=e.x0, fix=e.y0 - s["y0"] if goes_on and e.x0 > s["x0"] else 0.0)
            s["held"], s["reach"] = s["held"] + 1, max(s["reach"], e.x0)
        else:
            if not blank and (e.size > s["size"] or s["core"] == 1):
                s["y"], s["size"] = s["y"] - (e.size - s["size"]), e.size
            piece += e.text
            _grow(s, e.text)
            s["gstate"], s["styled"] = e.gstate if not s["styled"] or s["gstate"] == e.gstate else None, True
        s["cls"], s["x0"], s["x1"], s["y0"] = cls, e.x0, e.x1, e.y0
        return s["para"], s["formulas"] if formula else None, piece, e.x0, e.y0, e.x1, e.y1, blank and not strict, False, s["size"], s["y"], s["brk"], s["gstate"], s["fix"], *shut

    text = F.coalesce("text", F.lit(""))
    text = text if strict else F.when(text.rlike(BLANKS), " ").otherwise(text)
    rows = chars.select(*by, order, text.alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "size")], "cls", "formula", F.col("gstate").cast("string").alias("gstate"), "line")
    return fold(rows, by, [order], start, step, _OUT)


def paragraphs(marked: DataFrame, by: list[str], order: str) -> DataFrame:
    """The paragraphs that mark_characters found: text with {v0}, {v1} for formulas, box, size, base line, brk and the state of graphics.

    Blanks do not widen a box, but the first character's left edge is always in it. gstate is null where the characters of the text differ.
    """
    solid = lambda c: F.when(~F.col("blank"), F.col(c))
    first, last = (lambda c: F.min_by(c, order)), (lambda c: F.max_by(c, order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda p: p["piece"]), "")
    grouped = marked.filter(~F.col("line")).groupBy(*by, "para").agg(
        text.alias("text"), first("x0").alias("x"), last("y").alias("y"), last("size").alias("size"), last("brk").alias("brk"), last("gstate").alias("gstate"),
        F.least(first("x0"), F.min(solid("x0"))).alias("x0"), F.least(first("y0"), F.min(solid("y0"))).alias("y0"),
        F.greatest(first("x0"), F.max(solid("x1"))).alias("x1"), F.greatest(first("y1"), F.max(solid("y1"))).alias("y1"),
    )
    return grouped


def formulas(marked: DataFrame, by: list[str], order: str) -> DataFrame:
    """The formulas that mark_characters found: paragraph, how many characters and lines, length from the first character on, and how far raised."""
    char, line = F.col("line") == F.lit(False), F.col("line") == F.lit(True)
    own = F.struct("formula", "para", order, "x0", "x1", "line", "fix", F.lit(None).cast("double").alias("shut_fix"))
    none = [F.lit(None).cast(t) for t in ("long", dict(marked.dtypes)[order], "double", "double", "boolean", "double")]
    end = F.struct(F.col("shut").alias("formula"), *[n.alias(c) for n, c in zip(none, ("para", order, "x0", "x1", "line", "fix"), strict=True)], "shut_fix")
    rows = marked.select(*by, F.explode(F.array(own, end)).alias("f")).select(*by, "f.*").filter("formula IS NOT NULL")
    at = F.when(char, F.col(order))
    return rows.groupBy(*by, "formula").agg(
        F.max("para").alias("para"), F.count_if(char).alias("chars"), F.count_if(line).alias("lines"),
        (F.max(F.when(char, F.col("x1"))) - F.min_by("x0", at)).alias("len"), F.coalesce(F.max("shut_fix"), F.min_by("fix", at)).alias("fix"),
    )


def sized_blanks(chars: DataFrame, by: list[str], order: str) -> DataFrame:
    """Characters (x0, x1, dummy) with x1 of the blanks put in at line breaks, which have no width of their own, set.

    A blank is as wide as it is far to the next drawn character, but no wider than the paragraph's second smallest distinct gap over 1 between drawn
    ones (the only one, or 1, if there aren't two), which it also is where none follows. Each gap is found by one window, and gaps are
    gathered by paragraph, each distinct one once.
    """
    w = Window.partitionBy(*by).orderBy(order)
    drawn = F.when(~F.col("dummy"), F.col("x0"))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    looked = chars.withColumn("__next", F.first(drawn, ignorenulls=True).over(ahead))
    gap = F.when(~F.col("dummy") & (F.col("__next") - F.col("x1") > 1), F.col("__next") - F.col("x1"))
    gaps = looked.groupBy(*by).agg(F.collect_set(gap).alias("__gaps")).select(*by, second_gap(F.col("__gaps")).alias("__wide"))
    far = F.least(F.coalesce(F.abs(F.col("__next") - F.col("x0")), F.col("__wide")), F.col("__wide"))
    sized = F.when(F.col("dummy") & (F.col("x0") == F.col("x1")), F.col("x0") + far).otherwise(F.col("x1"))
    return looked.join(gaps, by).withColumn("x1", sized).drop("__next", "__wide")
