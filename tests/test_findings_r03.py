"""What a round's findings told of: rules and work that only larger or odder tables put to the test."""

import random
import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parchment import queries as engine
from parchment.functions import marks, predicates, text, tokens
from parchment.functions.text import clean_json_output
from parchment.operators import batching, geometry, layout, machines
from parchment.operators.replies import extracted_terms
from parchment.sources import glossaries
from parchment.streaming.jobs import BLOCK, Jobs


def both(spark, folder, name, **tables):
    """The rows of a query and those of its SQL over tables (rows, schema)."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, (rows, schema) in tables.items():
        path = str(folder / f"{table}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = engine.queries()[name](spark, str(folder))
    said = con.execute(engine.oracle_sql()[name])
    want = [dict(zip([c[0] for c in said.description], r, strict=True)) for r in said.fetchall()]
    plain = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert plain(got.toArrow().to_pylist()) == plain(want)
    return want


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"


def test_part_keys_over_a_million_keep_the_spine_in_order(spark, tmp_path):
    lines = [(1, p, 1, n, 1.0, 1.0, 0.0, "N", "O") for n, p in ((1, 1_200_000), (2, 5), (3, 7))]
    got = both(spark, tmp_path, "page_spine", lineitem=(lines, LINES), orders=([(1,), (2,)], "o_orderkey long"))
    assert {r["page"]: r["ords"] for r in got} == {1: "2000005,2200000,3000007", 2: ""}


def test_halves_of_a_megabyte_go_up(spark, tmp_path):
    sizes = [0, 1, 1536, 2560, 3584, 40_960, 1_000_000]
    got = both(spark, tmp_path, "size_format", documents=([(n, n) for n in sizes], "doc_id long, n_chars long"))
    assert {r["doc_id"]: r["size"] for r in got}[1536] == "2.3 MB"


def test_small_groups_share_batches_of_results():
    batch = pa.record_batch({"page": [i // 2 for i in range(3000)], "id": list(range(3000))})
    got = list(geometry.group_batches(iter([batch.slice(0, 1001), batch.slice(1001)]), 1, lambda held: held, batch.schema))
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist() and len(got) == 1


def test_pairs_of_few_boxes_are_those_of_the_sweep():
    r = random.Random(5)
    for n in range(2, 40):
        p = [[x, y, x + r.randint(0, 9), y + r.randint(0, 9)] for x, y in ((r.randint(0, 20), r.randint(0, 20)) for _ in range(n))]
        first, second = geometry.overlapping(np.array(p, float))
        assert geometry.few_overlapping(p) == sorted(zip(first.tolist(), second.tolist(), strict=True))


def test_small_pages_are_parted_together(monkeypatch):
    r, alone = random.Random(9), []
    pages = [[[x, y, x + r.randint(0, 30) / 3, y + r.randint(0, 30) / 3] for x, y in ((r.randint(0, 60) / 3, r.randint(0, 60) / 3) for _ in range(r.choice([1, 2, 3, 5, 9, 24, 30])))] for _ in range(400)]
    pages[3][0][1] = pages[5][0][2] = float("nan")
    given, starts = np.array([box for p in pages for box in p], float), np.cumsum([0, *map(len, pages)])[:-1]
    want = [geometry.part([[*map(float, box)] for box in p]) for p in pages]
    plain = geometry.part
    monkeypatch.setattr(geometry, "part", lambda p, *turn: alone.append(len(p)) or plain(p, *turn))
    assert np.array_equal(geometry.part_pages(given.copy(), starts), [box for p in want for box in p], equal_nan=True)
    assert sum(n <= geometry.FEW_BOXES for n in alone) <= geometry.FEW_PAGES < len(pages)


def test_batches_are_cut_between_groups():
    keys = [None, None, *[1] * 40, 2, 3, 3, 3]
    whole = pa.record_batch({"page": pa.array(keys, pa.int64()), "name": pa.array(["a"] * 20 + [None] * 26), "id": list(range(46))})
    for rows in (1, 2, 7, 22, 46):
        got = list(geometry.whole_groups((whole.slice(at, rows) for at in range(0, 46, rows)), 2))
        assert pa.Table.from_batches([b for b, _ in got]).to_pylist() == whole.to_pylist()
        firsts = [b.column("id")[int(at)].as_py() for b, starts in got for at in starts]
        assert firsts == [0, 2, 20, 42, 43]


def test_cleaned_json_names_its_text_once(spark):
    assert str(clean_json_output(F.col("reply"))).count("reply") == 1
    assert str(extracted_terms(F.col("reply"))).count("reply") == 1
    said = ['<json>```json [{"src": "abc", "tgt": "d"}]\n```</json>', '```\n{"src": "abc", "tgt": "d"}```', "", "[]", None, '{"src": "x\\ny z", "tgt": "$1"}']
    got = [r.t for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, reply string").orderBy("i").select(extracted_terms(F.col("reply")).alias("t")).collect()]
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[("abc", "d")], [("abc", "d")], [], [], None, [("x\ny z", "$1")]]


def test_errors_in_replies_read_their_body_once(spark):
    assert str(predicates.classify_reply(F.col("s"), F.col("body"))).count("get_json_object") == 1
    assert str(predicates.classify_http(F.col("s"), F.col("body"))).count("body") == 1


def test_boxes_are_shuffled_once_as_one_number(spark):
    boxes = spark.range(9).selectExpr("id % 8 AS page", "2.0D + 60 * (id div 8) AS x0", "2.0D AS y0", "9.0D + 60 * (id div 8) AS x1", "9.0D AS y1", "64 AS page_w", "64 AS page_h")
    boxes = boxes.unionAll(spark.range(1).selectExpr("9L", "3.0D", "3.0D", "1.0D", "5.0D", "64", "64")).unionAll(spark.range(1).selectExpr("10L", "-5.0D", "-5.0D", "99.0D", "99.0D", "64", "64"))
    plan = layout.coverage(boxes, ["page"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    want = {page: 49 / 4096 for page in range(1, 8)} | {0: (49 + 14) / 4096, 9: 0.0, 10: 1.0}
    assert {r.page: r.coverage for r in layout.coverage(boxes, ["page"]).collect()} == want


def test_few_rows_are_python_objects_at_once():
    seen = []
    got = text.by_slices(lambda a, b: seen.append(len(a)) or [x + y for x, y in zip(a, b, strict=True)], pa.int64(), pa.array(range(1000)), pa.array(range(1000)))
    assert got.to_pylist() == [2 * i for i in range(1000)] and max(seen) <= text.SLICE_ROWS
    assert text.by_slices(lambda a: a, pa.string(), pa.array([], pa.string())).to_pylist() == []


def test_marks_are_sent_without_other_columns_of_parts(spark):
    assert "transform" in str(marks.marked_text(F.col("parts"), F.col("whole")))


def test_marks_are_put_in_without_python(spark):
    r = random.Random(4)
    texts = ["", None, "{v1} x", "{ V\u30002 } x", "<style id='2'>", "< ſtyle\u00a0İd = ' 4'> x", "{v007} x", "{v99999999999} x", " {v1} x", "{v41}x", "{v0}x", "x"]
    part = lambda odds: (r.choices(["formula", "run", None], odds)[0], r.choice(["a", "b c", "", None]), r.choice([True, False, None]))
    cases = [([part(r.choice([(1, 1, 0), (1, 8, 1), (5, 1, 0)])) for _ in range(r.choice([2, 3, 9, 40, 41, 70, 150]))], r.choice(texts)) for _ in range(300)]
    cases.append(([("formula", "x", None), ("run", "y", False)] * 50_000, "{v7} x"))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, parts array<struct<kind:string,text:string,plain:boolean>>, whole string")
    df = df.select("i", marks.marked_text(F.col("parts"), F.col("whole")).alias("s"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {row["i"]: row["s"] for row in df.toArrow().to_pylist()}
    for i, (parts, whole) in enumerate(cases):
        bare = (whole or "") != "" and not re.sub(r"\{v\d+\}", "", whole).strip()
        assert got[i] == (None if bare else marks.mark([dict(zip(("kind", "text", "plain"), p, strict=True)) for p in parts], whole))


def test_values_of_columns_are_those_of_arrow():
    for kind, some in ((pa.int64(), [2**60 + 1, -1]), (pa.int32(), [3]), (pa.float64(), [0.1, float("inf")]), (pa.bool_(), [True, False]), (pa.string(), ["a", "é", ""]), (pa.timestamp("us", "UTC"), [5])):
        for rows in (some, [*some, None], []):
            array = pa.array(rows, kind)
            assert machines.values(array) == array.to_pylist() and [*map(type, machines.values(array))] == [*map(type, array.to_pylist())]


def test_texts_of_ascii_are_not_sent(spark):
    assert "octet_length" in str(tokens.nfkc(F.col("t")))


def test_stable_characters_are_left_alone_by_composition():
    stable = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", tokens.STABLE) + "]")
    seconds = {*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A7, 0x11C3))}
    signs = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) != "Cs"]
    for c in signs:
        d = unicodedata.decomposition(c)
        seconds.update(chr(int(x, 16)) for x in (d.split()[1:] if d and d[0] != "<" else []))
    kept = [c for c in signs if stable.match(c)]
    assert len(kept) > 80_000 and not [c for c in kept if unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c) or c in seconds or unicodedata.category(c) == "Cn"]


def test_only_what_composition_may_change_is_sent(spark):
    r = random.Random(11)
    odd = ["e\u0301", "\u0301", "ﬁ", "①", "　", "\u1100\u1161\u11a8", "가\u11a8", "ｶﾞ", "字，", "é", "a\u0323\u0307", "\n", "\r\n", "Å", "\U0001d400", "q", " ", "😀", "שּׁ", "한", "\u0f73", "नि"]
    said = ["", None, "abc", "é", "ﬁ", *["".join(r.choice(odd) for _ in range(r.randint(1, 30))) for _ in range(500)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").select("i", tokens.nfkc(F.col("t")).alias("n"))
    assert [row.n for row in df.orderBy("i").collect()] == [s if s is None else unicodedata.normalize("NFKC", s) for s in said]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" in plan


def test_entries_of_a_glossary_come_one_after_another():
    found = glossaries.file_entries("\ufeffx,target,source\r\n\r\n1,b,a\r\n2\r\n".encode())
    assert iter(found) is found and list(found) == [(1, "a", "b", None), (2, "", "", None)]
    assert glossaries.file_entries(b"source,b\na,b") is None and glossaries.file_entries(None) is None


def test_runs_are_given_out_by_the_task_that_reads_them(spark):
    rows = [(1, i, "char", f, s, None) for i, (f, s) in enumerate([("a", 1.0), ("a", 1.01), ("a", 1.03), ("b", 1.03), ("b", None), ("b", None)])] + [(2, 0, "char", "b", 1.0, None)]
    df = batching.style_runs(spark.createDataFrame(rows, "doc long, ord int, kind string, font string, size double, gstate string"), ["doc"], "ord")
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[:4] + tuple(r)[4:5] + tuple(r)[-1:] for r in df.collect()) == [(1, 1, 0, 1, "a", 2), (1, 2, 2, 2, "a", 1), (1, 3, 3, 3, "b", 1), (1, 4, 4, 4, "b", 1), (1, 5, 5, 5, "b", 1), (2, 1, 0, 0, "b", 1)]


class Entries(dict):
    """A map of state that counts what is written to it."""

    writes = 0

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self[key] = value

    getValue, containsKey, removeKey = dict.__getitem__, dict.__contains__, dict.pop  # noqa: N815


def test_early_events_share_entries_of_state():
    jobs = Jobs("user_id")
    jobs.early = Entries()
    many = {n: (n, "start", False) for n in range(2, 2 * BLOCK)}
    jobs._keep(0, {n: e for n, e in many.items() if n < BLOCK})
    assert jobs.early.writes == 1 and jobs._block(0, {})[7] == (7, "start", False) and jobs._block(1, {}) == {}
    jobs._keep(0, {})
    assert not jobs.early
