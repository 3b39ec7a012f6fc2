"""Paragraphs and formulas of small pages, character by character."""

from pyspark.sql import functions as F

from parchment.functions.predicates import is_formula_font
from parchment.operators import paragraphs as P

FIELDS = "page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, size double, cls int, font string, vertical boolean, gstate string, line boolean"


def char(text, x, y=700.0, *, size=10.0, x1=None, cls=2, font="Times-Roman", vertical=False, gstate=""):
    return text, float(x), float(y), float(x + 5 if x1 is None else x1), y + size, size, cls, font, vertical, gstate, False


def word(text, x, y=700.0, **more):
    return [char(c, x + 5 * i, y, **more) for i, c in enumerate(text)]


def math(text, x, y=700.0, **more):
    return char(text, x, y, font="CMMI10", **more)


def line(x, y, cls=2):
    return None, float(x), float(y), float(x + 10), float(y), None, cls, None, None, None, True


def found(spark, items, strict=False, width=600.0, page=1):
    chars = spark.createDataFrame([(page, i, *c) for i, c in enumerate(items)], FIELDS)
    chars = chars.withColumn("formula", P.looks_like_formula(F.col("text"), is_formula_font(F.col("font"), [], []), F.col("vertical")))
    marked = P.mark_characters(chars, ["page"], "ord", width, strict)
    return P.paragraphs(marked, ["page"], "ord").orderBy("para").collect(), P.formulas(marked, ["page"], "ord").orderBy("formula").collect()


def texts(spark, items, **more):
    return [p.text for p in found(spark, items, **more)[0]]


def test_gaps_are_blanks_and_returns_break(spark):
    [p], none = found(spark, [*word("ab", 10), *word("cd", 30)])
    assert (p.text, p.x, p.y, p.x0, p.x1, p.brk, none) == ("ab cd", 10, 700, 10, 40, False, [])
    [p], _ = found(spark, [*word("ab", 10), *word("cd", 0, 685)])
    assert (p.text, p.brk, p.y0, p.y1) == ("ab cd", True, 685, 710)
    assert texts(spark, [*word("top", 10), *word("low", 10, 100, cls=3)]) == ["top", "low"]


def test_what_is_a_formula(spark):
    assert texts(spark, word("fig", 10, cls=0)) == ["{v0}"] and texts(spark, [char("•", 10)]) == ["{v0}"]
    items = [*word("Let", 10), math("x", 30), char("(", 35), char("t", 40), char(")", 45), char("2", 50, 697, size=7.0), *word("be", 70)]
    [p], made = found(spark, items)
    assert p.text == "Let {v0}t{v1} be" and [f.chars for f in made] == [2, 2]
    assert texts(spark, [*word("ab", 10), char("c", 20, vertical=True)]) == ["ab{v0}"]
    assert texts(spark, [*word("ab", 10), char("α", 20), *word("cd", 25)]) == ["ab{v0}cd"]
    assert texts(spark, [math("x", 10), *word("text", 30)]) == ["{v0}", "text"]


def test_formulas_have_length_lines_and_height(spark):
    _, [f] = found(spark, [*word("ab", 10), math("x", 25, 703), *word("cd", 40)])
    assert f.fix == 3 and f.para == 0
    _, [f] = found(spark, [*word("ab", 10), math("x", 25, 705, x1=30), line(25, 703), math("y", 25, 695, x1=32), *word("cd", 45), line(0, 100)])
    assert (f.len, f.lines, f.chars, f.fix) == (7, 1, 2, 5)
    assert texts(spark, [*word("ab", 10), math("x", 20), math("y", 200, 690)]) == ["ab{v0} {v1}"]


def test_first_letters_give_way_and_larger_ones_rule(spark):
    [p], _ = found(spark, [char("A", 10, size=20.0), *word("bc", 30)])
    assert (p.size, p.y) == (10, 710)
    [p], _ = found(spark, [*word("ab", 10), char("C", 20, size=14.0)])
    assert (p.size, p.y) == (14, 696)


def test_blanks_stay_with_what_is_before_them(spark):
    small = [*word("ab", 10), char(" ", 20, size=6.4), *word("cd", 25)]
    assert texts(spark, small) == ["ab cd"] and texts(spark, small, strict=True) == ["ab{v0}cd"]
    assert texts(spark, [*word("ab", 10), char(" ", 20), *word("cd", 25)]) == ["ab cd"]
    [p], [f] = found(spark, [*word("ab", 10), math("x", 25), char(" ", 30), math("y", 35)])
    assert p.text == "ab {v0}" and f.chars == 3
    [p], _ = found(spark, [*word("ab", 10), char(" ", 20, cls=5, x1=90), *word("cd", 25)])
    assert p.text == "ab cd" and p.x1 == 35


def test_states_of_graphics_and_odd_rows(spark):
    assert found(spark, word("ab", 10, gstate="r"))[0][0].gstate == "r"
    assert found(spark, [*word("ab", 10, gstate="r"), char("c", 20, gstate="b"), char("d", 25, gstate="r")])[0][0].gstate is None
    assert found(spark, []) == ([], []) and found(spark, [line(1, 2)]) == ([], [])
    assert [p.text for p in found(spark, [char(None, 10), char("a", 15)], page=None)[0]] == ["a"]
    [p], _ = found(spark, word("x" * 20_000, 10), width=600.0)
    assert len(p.text) == 20_000
