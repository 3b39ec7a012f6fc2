"""Marks in paragraphs and what replies make of them; joins of units on rows that tie, lack keys or repeat."""

from pyspark.sql import functions as F

from parchment.functions import marks
from parchment.operators import units

PARTS = "k int, parts array<struct<kind:string,text:string,plain:boolean>>, whole string"


def sent(spark, parts, whole):
    got = spark.createDataFrame([(1, parts, whole)], PARTS).select(marks.marked_text(F.col("parts"), F.col("whole")).alias("s")).first().s
    return got and (got.text, [(m.kind, m.id, m.part) for m in got.marks])


def test_marks_are_numbered(spark):
    f, plain, bold = ("formula", "x+y", None), ("run", "plain ", True), ("run", "bold", False)
    assert sent(spark, [plain, f, bold, f], "") == ("plain {v1}<style id='2'>bold</style>{v4}", [("formula", 1, 1), ("run", 2, 2), ("formula", 4, 3)])
    assert sent(spark, [plain, f], "{ V 1 } is here")[0] == "plain {v2}" and sent(spark, [plain, f], "so is {v1}")[0] == "plain {v1}"
    assert sent(spark, [plain, bold], "< style id='1'>")[0] == "plain <style id='2'>bold</style>"
    assert sent(spark, [f], "x") is None and sent(spark, [], "x") is None and sent(spark, [bold], "all of it") == ("all of it", [])
    assert len(sent(spark, [plain, f] * 41, "")[1]) == 41
    text, found = sent(spark, [f, *[bold, plain] * 40], "")
    assert "style" not in text and found == [("formula", 1, 0)] and len(sent(spark, [f, *[bold, plain] * 39], "")[1]) == 40


MARKS = [{"kind": "formula", "id": 1, "part": 1, "text": "x"}, {"kind": "run", "id": 2, "part": 2, "text": "bold it"}]


def pieces(reply, found=MARKS, own=()):
    return [(p["kind"], p["part"], p["text"]) for p in marks.split_reply(reply, found, set(own))]


def test_replies_are_split(spark):
    assert pieces("a {v1} b <style id='2'>boldit</style> c") == [("text", None, "a "), ("formula", 1, None), ("text", None, " b "), ("original", 2, None), ("text", None, " c")]
    assert pieces("{ V 1 }< STYLE id = ' 2 ' >new {v1}{v7}</ style >") == [("formula", 1, None), ("run", 2, "new ")]
    assert pieces("x {v7} y</style>") == [("text", None, "x  y")] and pieces("x {v7} {V7}", own=["{v7}"]) == [("text", None, "x {v7} ")]
    assert pieces("<style id='2'>two\nlines</style>") == [("text", None, "two\nlines")]
    assert pieces("<style id='2'>open {v1}") == [("text", None, "open "), ("formula", 1, None)]
    assert pieces("{v1}{v1}") == [("formula", 1, None)] * 2 and pieces("") == []
    assert pieces("kept {v7}", []) == [("text", None, "kept {v7}")]
    df = spark.createDataFrame([("a{v1}", "s"), (None, "s"), ("", None)], "r string, s string")
    kind = "array<struct<kind:string,id:int,part:int,text:string>>"
    got = df.select(marks.reply_pieces(F.col("r"), F.array().cast(kind), F.col("s")).alias("p")).collect()
    assert [r.p and r.p[0].text for r in got] == ["a{v1}", None, ""]


def test_units(spark):
    units_ = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (None, 12, 0)], "page int, seq int, ord int")
    chars = spark.createDataFrame([(1, 9), (1, 10), (1, 11), (1, 8), (None, 12)], "page int, seq int")
    got = units.reattach(units_, chars, ["page"]).filter("page = 1").orderBy("place").collect()
    assert [(r.seq, r.matched) for r in got] == [(11, True), (10, True), (8, False), (9, False)]
    spine = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (3, 1, "c")], "page int, ord int, t string")
    on = {r.page: [i.t for i in r["items"]] for r in units.on_spine(spine, rows, ["page"], spine.filter("page < 3")).collect()}
    assert on == {1: ["a", "b"], 2: [], 3: []}
    cache = spark.createDataFrame([("a", "old", 1), ("b", "kept", 9)], "key string, text string, at int")
    flushed = spark.createDataFrame([("a", "new", 1), ("b", "late", 3), ("c", "c", 1)], "key string, text string, at int")
    assert {r.key: r.text for r in units.upsert(cache, flushed, "key", "at").collect()} == {"a": "new", "b": "kept", "c": "c"}
