"""Cases that the given tables don't show: caps, nulls, large keys, close sizes, cancelled jobs, colliding names."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.functions import tokens
from parchment.operators import batching, catalog, glossary, layout, machines, segments


def test_glossary_of_many_terms(spark):
    entries = spark.range(25_000).select(F.col("id").alias("ord"), F.concat(F.lit("Term"), F.col("id"), F.lit("x")).alias("source"), F.lit("t").alias("target"))
    entries = entries.unionByName(spark.createDataFrame([(99_999, "", "none"), (99_998, "Été x", None), (99_997, None, "z")], "ord long, source string, target string"))
    texts = spark.createDataFrame([(1, "a tERM24999x and\n term7x, ÉTÉ x Été  X"), (2, None), (3, "nothing"), (4, "term1x" * 1000)], "id long, text string")
    for block in (4 << 20, 300_000):
        got = {r.id: [t.ord for t in r.terms] for r in glossary.matches(texts, entries, block_bytes=block).collect()}
        assert got == {1: [7, 24_999, 99_998], 2: [], 3: [], 4: [1]}


def test_coverage_equals_plain(spark):
    rng = np.random.default_rng(1)
    boxes = [(int(p), *map(float, (x, y, x + w, y + h))) for p, x, y, w, h in zip(rng.integers(0, 4, 60), *(rng.uniform(-10, 110, (2, 60))), *(rng.uniform(-1, 40, (2, 60))), strict=True)] + [(9, 5.0, 5.0, 5.1, 5.1)]
    df = spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double").withColumns({"page_w": F.lit(100.0), "page_h": F.lit(120.0)})
    for grid in (64, 10):
        want = {p: sum(any(b[0] == p and b[1] <= (i + 0.5) * 100 / grid <= b[3] and b[2] <= (j + 0.5) * 120 / grid <= b[4] for b in boxes) for i in range(grid) for j in range(grid)) / grid**2 for p in {b[0] for b in boxes}}
        assert {r.page: r.coverage for r in layout.coverage(df, ["page"], grid).collect()} == pytest.approx(want)


def test_overlaps_are_parted_however_many_rounds_it_takes(spark):
    rows = [(1, k, 0.0, k * 4.0, 10.0, k * 4.0 + 9.0) for k in range(90)] + [(2**60 + 3, 0, 0.0, 0.0, 1.0, 1.0)] + [(None, 0, 0.0, 0.0, 10.0, 12.0), (None, 1, 0.0, 8.0, 10.0, 20.0)]
    got = layout.separate_overlaps(spark.createDataFrame(rows, "page long, b int, x0 double, y0 double, x1 double, y1 double"), "page", "b").collect()
    assert len(got) == len(rows) and {r.page for r in got} == {1, None, 2**60 + 3}
    p = [[0.0, k * 4.0, 10.0, k * 4.0 + 9.0] for k in range(90)]
    moved, rounds = True, 0
    while moved and rounds < 90**2:
        moved, rounds = False, rounds + 1
        for i in range(90):
            for j in range(i + 1, 90):
                bottom, top = max(p[i][1], p[j][1]), min(p[i][3], p[j][3])
                inside = (p[i][1] >= p[j][1] and p[i][3] <= p[j][3]) or (p[j][1] >= p[i][1] and p[j][3] <= p[i][3])
                if not inside and top - bottom > 1e-6:
                    low, high = (p[i], p[j]) if p[i][3] < p[j][3] else (p[j], p[i])
                    if high[1] < (bottom + top) / 2 < low[3]:
                        high[1], low[3], moved = (bottom + top) / 2 + 1, (bottom + top) / 2 - 1, True
    assert [[r.x0, r.y0, r.x1, r.y1] for r in sorted((r for r in got if r.page == 1), key=lambda r: r.b)] == p


def test_close_sizes_are_one_run(spark):
    rows = [(1, k, "char", "A", s, None) for k, s in enumerate([10.0099, 10.0101, 10.02, 10.03, 10.04, 9.99])] + [(1, 6, "formula", "A", 9.99, None), (1, 7, "char", "B", 9.99, None), (1, 8, "char", "B", 9.99, "red"), (None, 0, "char", "B", 9.99, None), (2**60 + 1, 0, "char", None, None, None), (2**60 + 1, 1, "char", None, None, None)]
    got = batching.style_runs(spark.createDataFrame(rows, "doc long, ord int, kind string, font string, size double, gstate string"), ["doc"], "ord").collect()
    assert sorted((r.run, r.first, r.last) for r in got if r.doc == 1) == [(1, 0, 2), (2, 3, 4), (3, 5, 5), (4, 6, 6), (5, 7, 7), (6, 8, 8)]
    assert {r.doc for r in got} == {1, None, 2**60 + 1}


def test_keys_of_machines_may_be_null_or_large(spark):
    big = 1152921504606846977
    rows = [(k, i, 20_000 * i, "rate_limited") for k in (None, big, 5) for i in range(3)]
    got = machines.concurrency(spark.createDataFrame(rows, "k long, i int, t_ms long, outcome string"), "k", ["i"], 32).collect()
    assert sorted(((r.k or 0), r.i, r.current) for r in got) == sorted((k or 0, i, 16 >> i) for k in (None, big, 5) for i in range(3))


@pytest.mark.parametrize(
    "outcomes, want",
    [("start cancel done", "completed"), ("start cancel error", "cancelled"), ("cancel start", "cancelled"), ("start done cancel", "completed"), ("start error cancel recover", "cancelled"), ("start recover start done", "completed")],
)
def test_life_of_a_job(outcomes, want):
    job = {"status": "queued", "attempts": 0, "due": 0}
    for i, o in enumerate(outcomes.split()):
        machines.job_step(job, o, False, i)
    assert job["status"] == want


def test_settings_merge(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": None, "c": "3"})], "x map<string,string>, y map<string,string>")
    assert df.select(tokens.merged_settings(F.col("x"), F.col("y")).alias("m")).first().m == {"a": None, "b": "2", "c": "3"}
    pairs = [('{"a":{"b":1,"c":2},"d":[1]}', '{"a":{"c":null,"e":3},"d":[2,3]}', {"a": {"b": 1, "c": None, "e": 3}, "d": [2, 3]}), ('{"a":1}', '{"a":{"b":2}}', {"a": {"b": 2}}), ("no", None, {}), ('{"é":1}', "[1]", {"é": 1})]
    got = spark.createDataFrame([p[:2] for p in pairs], "x string, y string").coalesce(1).select(tokens.merged_json(F.col("x"), F.col("y")).alias("m")).collect()
    assert [json.loads(r.m) for r in got] == [p[2] for p in pairs]


def test_names_stay_unique_where_endings_collide(spark):
    rng = random.Random(3)
    names = ["a", "a", "a#1", "a", "b#1", "b", "b", None, None] + [rng.choice(["x", "x#1", "x#2", "x#1#1", "y"]) for _ in range(200)]
    want, taken = [], set()
    for n in names:
        found, k = n or "", 0
        while found in taken:
            k += 1
            found = f"{n or ''}#{k}"
        taken.add(found)
        want.append(found)
    got = catalog.unique_names(spark.createDataFrame(list(enumerate(names)), "i int, n string"), "n", "i").orderBy("i").collect()
    assert [r.unique for r in got] == want and want[:4] == ["a", "a#1", "a#1#1", "a#2"]


def test_the_first_change_that_holds_applies(spark):
    docs = spark.createDataFrame([(1, "queued", "x"), (2, "failed", "x"), (3, None, "x")], "id int, status string, new string")
    changes = spark.createDataFrame([(1, "queued", "processing", 2), (1, "queued", "cancelled", 1), (1, "failed", "queued", 0), (2, "queued", "done", 0), (3, None, "queued", 0)], "id int, expected string, status string, at int")
    got = {r.id: (r.status, r.new, r.changed) for r in catalog.update_when(docs, changes, ["status"], "at").collect()}
    assert got == {1: ("cancelled", "x", True), 2: ("failed", "x", False), 3: (None, "x", False)}


def test_long_documents_are_packed_and_wrapped_in_linear_time(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "\n".join(["w w w"] * n)), (2, ""), (3, None)], "doc_id long, text string")
    got = batching.pack_lines(docs, 200, 5, lambda t: F.length(t) > 0).collect()
    assert len(got) == math.ceil(n / 6) and sum(r.n_items for r in got) == n and {(r.tokens, r.n_items) for r in got[:100]} == {(18, 6)}
    lines = docs.select("doc_id", F.size(batching.wrap_lines(F.split("text", r"\s+"), 60)).alias("n")).collect()
    assert [r.n for r in sorted(lines, key=lambda r: r.doc_id)][:1] == [math.ceil(3 * n / 30)]


def test_packing_equals_the_plain_rule(spark):
    rng = np.random.default_rng(6)
    rows = [[(i, int(t)) for i, t in enumerate(rng.integers(0, 90, rng.integers(0, 60)))] for _ in range(40)]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, items array<struct<ord:int,tokens:bigint>>").select("k", batching.pack(F.col("items"), 200, 5).alias("b")).collect()
    for r in got:
        want, tokens_, ords = [], 0, []
        for o, t in rows[r.k]:
            tokens_, ords = tokens_ + t, [*ords, o]
            if tokens_ > 200 or len(ords) > 5:
                want.append((tokens_, ords))
                tokens_, ords = 0, []
        assert [(b.tokens, list(b.ords)) for b in r.b] == want + ([(tokens_, ords)] if ords else [])


def test_matches_keep_their_keys(spark):
    schema = "page long, seq long, path string, x double, y double"
    rows = [(p, i, "", float(i), 0.0) for p in (None, 2**60 + 1) for i in range(3)]
    got = segments.match_in_order(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema), "page").collect()
    assert sorted(((r.page or 0), r.seq, r.op_seq) for r in got) == sorted(((r[0] or 0), max(0, r[1]), r[1]) for r in rows)
