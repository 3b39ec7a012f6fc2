"""Replies, glossary files, files taken in, settings, templates, styles and blanks: the given cases and odd ones."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from parchment.functions import jsons, marks, numbers, text
from parchment.operators import layout, paragraphs
from parchment.sources import glossaries, library


def said(spark, *cases):
    rows = [(k, dialect, body if isinstance(body, str | None) else json.dumps(body)) for k, (dialect, body) in enumerate(cases)]
    got = spark.createDataFrame(rows, "k int, dialect string, body string").select("k", jsons.chat_reply(F.col("dialect"), F.col("body")).alias("r")).orderBy("k").collect()
    return [tuple(x.r) for x in got]


def chat(content, reason="stop", **more):
    return {"choices": [{"message": {"content": content, **more}, "finish_reason": reason}]}


def test_replies_of_all_dialects(spark):
    used = {"usage": {"prompt_tokens": 3, "completion_tokens": 4.0}}
    part = lambda t, **more: {"text": t, **more}
    gemini = lambda parts, **more: {"candidates": [{"content": {"parts": parts}, **more}]}
    assert said(
        spark,
        ("openai", chat("hi") | used), ("azure", chat("hi", "model_length")), ("openai", chat("", "stop", refusal="no")), ("openai", chat("x", "stop", refusal="no")), ("openai", chat("", refusal="")), ("openai", chat("x", "content_filter")),
        ("openai", chat([part("a", type="text", thought=True), part("b", thought=True), part("c", thought="true"), "d", 5, part(6), {"type": "text"}])), ("openai", chat(None)), ("openai", chat({"text": "no"})), ("openai", {"choices": {}}),
        ("openai", chat(" <THINK>a\nb</thinking>\n <think>c</think>")), ("openai", chat("x <think>a</think>")), ("openai", chat("x", 5)), ("openai", chat("x") | {"usage": {"prompt_tokens": "3", "completion_tokens": 4}}),
        ("anthropic", {"content": [part("a", type="text"), part("b"), part("c", type="thinking"), part("d", type="text")], "stop_reason": "max_tokens", "usage": {"input_tokens": 1, "output_tokens": 2}}), ("anthropic", {"content": "text", "stop_reason": "refusal"}),
        ("gemini", gemini([part("a"), part("b", thought=True), part(1), part("c", thought=1)], finishReason="MAX_TOKENS") | {"usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 8}}), ("gemini", gemini([part("a")], finishReason="SPII")),
        ("gemini", gemini([part("a")]) | {"promptFeedback": {"blockReason": "SAFETY"}, "usageMetadata": {"promptTokenCount": 7, "candidatesTokenCount": 8}}), ("gemini", gemini([part("a")]) | {"promptFeedback": {"blockReason": ""}}), ("gemini", gemini([part("a")]) | {"promptFeedback": {"blockReason": None}}),
        ("openai", {"error": {"message": "bad"}} | chat("x")), ("openai", {"error": {"code": 5, "a": [1]}}), ("openai", {"error": "text"} | chat("x")), ("openai", {"error": None} | chat("x")), ("openai", "no json"), ("openai", None), ("openai", "[1]"), ("gemini", {}),
    ) == [
        ("hi", "complete", 3, 4, None), ("hi", "truncated", None, None, None), ("", "refused", None, None, None), ("x", "complete", None, None, None), ("", "complete", None, None, None), ("x", "refused", None, None, None),
        ("ac", "complete", None, None, None), ("", "complete", None, None, None), ("", "complete", None, None, None), ("", "complete", None, None, None),
        ("<think>c</think>", "complete", None, None, None), ("x <think>a</think>", "complete", None, None, None), ("x", "complete", None, None, None), ("x", "complete", None, None, None),
        ("ad", "truncated", 1, 2, None), ("", "refused", None, None, None),
        ("ac", "truncated", 7, 8, None), ("a", "refused", None, None, None),
        ("", "refused", None, None, None), ("a", "complete", None, None, None), ("a", "complete", None, None, None),
        (None, None, None, None, "bad"), (None, None, None, None, '{"code":5,"a":[1]}'), ("x", "complete", None, None, None), ("x", "complete", None, None, None), *[("", "complete", None, None, None)] * 4,
    ]


def test_values_as_python_writes_them(spark):
    cases = [('"a \\"b\\""', 'a "b"'), ("null", "None"), (" true", "True"), ("false ", "False"), ("12", "12"), ("1.0", "1"), ("-0.50", "-0.5"), ("100", "100"), ("-0", "0"), ('{"b": 1, "a": [true, null]}', '{"b":1,"a":[true,null]}'), ("[]", "[]"), ('""', ""), ("no", None), (None, None), ("", None)]
    got = spark.createDataFrame(cases, "j string, want string").select("want", jsons.python_str(F.col("j")).alias("got")).collect()
    assert [r.got for r in got] == [c[1] for c in cases]


def test_csv_as_python_reads_it():
    rows = glossaries.parsed_rows
    assert rows('a,b\r\n\r\n"x ""y"", z",1\n\n5" pipe,"q"\rlast') == [["a", "b"], ['x "y", z', "1"], ['5" pipe', "q"], ["last"]]
    assert rows("") == [] and rows(",\n") == [["", ""]] and rows('""\n') == [[""]] and rows('a,"b\nc"') == [["a", "b\nc"]] and rows('x"y"z,"open') == [['x"y"z', "open"]]
    assert rows("a" * 200_000)[0][0] == "a" * 200_000


def test_glossary_files(spark, tmp_path):
    golden = "﻿source,target,tgt_lng\r\nLarge Language Model,大语言模型,zh-CN\r\nlarge  language model,重复,\r\ntransformer,变换器,ja\r\n" + '"attention, please","注意，请",\r\n'
    (tmp_path / "g1.csv").write_bytes(golden.encode())
    (tmp_path / "g2.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "g3.csv").write_bytes("target,x,source\n词,,word\n只\n,,\n".encode("gb18030"))
    (tmp_path / "g4.csv").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"source,target\nx,y\n")
    wanted = spark.createDataFrame([(k, f"g{n}") for k, n in enumerate([1, 2, 3, 4, 5])], "place int, id string")
    known = spark.createDataFrame([("g1", "mine"), ("g5", "gone"), ("g9", "unused")], "id string, name string")
    good, bad = glossaries.load(wanted, known, glossaries.read_files(spark, str(tmp_path)), "zh_CN")
    assert [tuple(r)[2:] for r in good.orderBy("place", "ord").collect()] == [("mine", 1, "Large Language Model", "大语言模型"), ("mine", 4, "attention, please", "注意，请"), ("g3", 1, "word", "词"), ("g3", 2, "", "只")]
    assert sorted((r.id, r.name, r.why) for r in bad.collect()) == [("g2", "g2", "format"), ("g4", "g4", "missing"), ("g5", "gone", "missing")]


def test_files_are_taken_in_or_told_why_not(spark, tmp_path):
    for name, content in {"good.PDF": b"%PDF-1.4 x", "bad.pdf": b"PDF", "empty.pdf": b"", "text.txt": b"%PDF-", "noext": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in library.ingest(library.read_pdfs(spark, str(tmp_path))).collect()}
    assert {k: r.failure and r.failure.code for k, r in got.items()} == {"good.PDF": None, "bad.pdf": "no header", "text.txt": "not a PDF", "noext": "not a PDF"}
    made = got["good.PDF"].created
    assert (made.title, made.filename, made.bytes, len(made.id)) == ("good", "good.PDF", 10, 64) and got["bad.pdf"].failure.message == library.FAILURES["no header"]
    rows = [("a/a.pdf", 0, b"", "t"), ("a/b.pdf", 5, None, "t"), ("a/c.pdf", 600 << 20, None, None), ("a\\d.pdf", None, b"%PDF-1", "  "), ("e.pdf", None, b"%PDF-1", "x" * 400)]
    odd = library.ingest(spark.createDataFrame(rows, "path string, length long, content binary, asked string"), F.col("asked")).collect()
    assert [r.failure and r.failure.code for r in odd] == ["empty", "unreadable", "too large", None, None] and [r.created.title for r in odd[3:]] == ["d", "x" * 300]


def test_settings_fall_back(spark):
    files = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": "x"}'), (3, "{"), (4, None), (5, '{"k": null, "theme": "light"}'), (6, "{}")], "id int, value string")
    got = library.settings_of(files, "k bigint, theme string", {"k": 7, "theme": "dark"}).orderBy("id").collect()
    assert [(r.k, r.theme, r.broken) for r in got] == [(3, "dark", False), (7, "dark", True), (7, "dark", True), (7, "dark", True), (7, "light", False), (7, "dark", False)]


def test_templates_and_roles(spark):
    df = spark.createDataFrame([("$a $$b $c $c $_d9 $9",), ("$a",), (None,)], "t string")
    assert [r[0] for r in df.select(text.missing_names(F.col("t"), {"a": F.lit("x")})).collect()] == [["c", "_d9"], [], None]
    assert df.filter("t = '$a'").select(text.substitute_all(F.col("t"), {"a": F.lit("x")})).first()[0] == "x"
    with pytest.raises(Exception, match="missing template value c"):
        df.limit(1).select(text.substitute_all(F.col("t"), {"a": F.lit("x")})).collect()
    roles = [r[0] for r in spark.createDataFrame([("",), (None,), ("  be kind \n",), (f"x {text.STRICT} y",)], "t string").select(text.role_block(F.col("t"), "zh")).collect()]
    assert roles[0] == roles[1] and roles[0].endswith(f"into zh.\n\n{text.STRICT}") and roles[2:] == [f"be kind\n{text.STRICT}", f"x {text.STRICT} y"]


def test_matrices_are_taken_back(spark):
    m = [F.lit(v) for v in (2.0, 1.0, -1.0, 3.0, 5.0, 7.0)]
    both = spark.range(1).select(*numbers.multiply(m, numbers.inverse(m))).first()
    assert list(both) == pytest.approx([1, 0, 0, 1, 0, 0]) and spark.range(1).select(numbers.inverse([F.lit(v) for v in (1.0, 2.0, 2.0, 4.0, 0.0, 0.0)])[0]).first()[0] is None


def test_detected_boxes(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate([0.25, 0.3, 0.9, 0.3, None])], "page int, k int, conf double")
    assert [(r.k, r.box_idx) for r in layout.detected(df, ["page"], "k").orderBy("box_idx").collect()] == [(2, 0), (1, 1), (3, 2)]


PARTS = "parts array<struct<kind:string,text:string,plain:boolean>>, whole string"


def test_marks(spark):
    run = lambda t, plain=False: ("run", t, plain)
    formula = ("formula", "x", None)
    cases = [([], ""), ([formula], "x"), ([run("12")], "12"), ([run("{v1}")], "{v1}"), ([run("a"), formula], "7"), ([run("a", True), formula, run("b"), formula], "{V 1 }a"), ([formula, run("b")], "<style id='2'>"), (None, "x")]
    got = spark.createDataFrame(cases, PARTS).select(marks.marked_text(F.col("parts"), F.col("whole")).alias("m")).collect()
    assert [r.m and (r.m.text, [m.id for m in r.m.marks]) for r in got] == [None, None, None, None, None, ("a{v2}<style id='3'>b</style>{v5}", [2, 3, 5]), ("{v1}<style id='3'>b</style>", [1, 3]), None]
    many = [run("s")] * 41 + [formula]
    assert spark.createDataFrame([(many, "s" * 41)], PARTS).select(marks.marked_text(F.col("parts"), F.col("whole")).alias("m")).first().m.text == "s" * 41 + "{v1}"
    began = time.time()
    assert len(marks.mark([{"kind": "formula", "text": "x", "plain": None}] * 200_000, "x")["marks"]) == 200_000 and time.time() - began < 10


def test_plain_styles(spark):
    base = ("f", 10.0, None)
    cases = [(("f", 10.01, None), True), (("f", 12.9, None), True), (("f", 13.0, None), False), (("f", 7.0, None), False), (("f", 7.1, "g"), False), (("g", 10.0, None), False), (("serif", 10.0, None), True), (("serif", 9.0, None), False), ((None, None, None), False)]
    df = spark.createDataFrame([(*s, *base) for s, _ in cases], "font string, size double, g string, bf string, bs double, bg string")
    mapped = F.when(F.col("font") == "serif", "m").when(F.col("font") == "g", "n")
    got = df.select(marks.plain_style(F.col("font"), F.col("size"), F.col("g"), F.col("bf"), F.col("bs"), F.col("bg"), mapped, F.lit("m")).alias("p")).collect()
    assert [r.p for r in got] == [want for _, want in cases]


def test_blanks_at_line_breaks(spark):
    r = random.Random(2)
    rows = []
    for k in range(20):
        x = 0.0
        for i in range(r.randint(1, 15)):
            dummy = r.random() < 0.3
            rows.append((k, i, x, x if dummy else x + 5.0, dummy))
            x = 0.0 if dummy else x + 5 + r.choice([0, 0, 2.0, 3.5, 8.0])
    got = {(g.k, g.i): g.x1 for g in paragraphs.sized_blanks(spark.createDataFrame(rows, "k int, i int, x0 double, x1 double, dummy boolean"), ["k"], "i").collect()}
    for k in range(20):
        own = [x for x in rows if x[0] == k]
        drawn = [x for x in own if not x[4]]
        gaps = sorted({b[2] - a[3] for a, b in zip(drawn, drawn[1:]) if b[2] - a[3] > 1})
        wide = 1 if not gaps else gaps[0] if len(gaps) == 1 else gaps[1]
        for at, x in enumerate(own):
            after = next((y for y in own[at + 1 :] if not y[4]), None)
            want = x[2] + min(abs(after[2] - x[2]) if after else wide, wide) if x[4] else x[3]
            assert got[k, x[1]] == pytest.approx(want)
