import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.operators import batching, catalog, events, glossary, layout, machines, replies, segments
from parchment.sources import library
from parchment.streaming import logs


def sizes(spark, n, tokens, rule):
    items = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("int").alias("ord"), F.lit(tokens).cast("long").alias("tokens")))
    return [len(b.ords) for b in spark.range(1).select(batching.pack(items, *rule).alias("b")).first().b]


def test_packing(spark):
    assert sizes(spark, 14, 2, batching.TERMS) == [13, 1] and sizes(spark, 7, 2, batching.TRANSLATE) == [6, 1]
    assert sizes(spark, 3, 201, batching.TRANSLATE) == [1, 1, 1] and sizes(spark, 4, 100, batching.TRANSLATE) == [3, 1]


def test_pairs(spark):
    pages = spark.createDataFrame([("s", p, n, 0, max(0, n - 1)) for p, n in enumerate([2, 1, 1, 1, 0, 1, 3])], "src string, page long, n int, first int, last int")
    got = batching.cross_page_pairs(pages, ["src"], "page", "first", "last", "n").orderBy("page").collect()
    assert [(r.page, r.next_page, r.last, r.head) for r in got] == [(0, 1, 1, 0), (2, 3, 0, 0), (5, 6, 0, 0)]
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate([0, 30, 60, 90, 80, 120])], "page string, ord int, top int")
    assert [(r.ord, r.pair) for r in batching.cross_column_pairs(rows, ["page"], "ord", "top").orderBy("ord").collect()] == [(0, 1), (2, 3), (4, 5)]


def test_most_frequent_target_is_the_first_on_ties(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("b", "z", 4), ("b", "w", 5)], "s string, t string, ord int")
    assert {r.s: r.t for r in glossary.most_frequent(df, "s", "t", "ord").collect()} == {"a": "y", "b": "z"}


def test_glossary(spark):
    entries = spark.createDataFrame([(0, "Neural Net", "n"), (1, "neural  net", "m"), (2, "É", "e"), (3, "", "x")], "ord long, source string, target string")
    assert [r.ord for r in glossary.dedupe(entries, []).orderBy("ord").collect()] == [0, 2, 3]
    texts = spark.createDataFrame([(1, "a NEURAL\n net"), (2, "é"), (3, None)], "id int, text string")
    got = {r.id: r.terms and [t.ord for t in r.terms] for r in glossary.matches(texts, entries).collect()}
    assert got[1] == [0] and got[2] == [] and not got[3]


def trace(spark, outcomes, fold, *args):
    df = spark.createDataFrame([("d", i, t, o) for i, (t, o) in enumerate(outcomes)], "doc string, ord int, t_ms long, outcome string")
    return [r[2] for r in fold(df, "doc", ["ord"], *args).orderBy("ord").collect()]


def test_adaptive_concurrency(spark):
    got = trace(spark, [(0, "rate_limited"), (5_000, "rate_limited"), (10_000, "rate_limited")], machines.concurrency, 100)
    assert got == [50, 50, 25]
    got = trace(spark, [(0, "rate_limited")] + [(1, "ok")] * (50 + 62 + 77 + 96), machines.concurrency, 100)
    assert [got[0], got[50], got[112], got[189], got[285]] == [50, 62, 77, 96, 100] and got[49] == 50


def test_key_ring(spark):
    assert trace(spark, [(0, "ok"), (1, "ok"), (2, "ok"), (3, "ok")], machines.key_ring, 3) == [0, 1, 2, 0]
    assert trace(spark, [(0, "credential"), (1, "ok"), (2, "credential"), (3, "ok"), (700_000, "ok")], machines.key_ring, 2) == [0, 1, 1, -1, 1]
    assert trace(spark, [(0, "credential"), (1, "ok")], machines.key_ring, 1) == [0, 0]


def test_retries_and_jobs(spark):
    df = spark.createDataFrame([("d", i, k, None) for i, k in enumerate(["transient"] * 3 + [None] + ["rejected"] * 6 + ["transient"])], "doc string, ord int, kind string, retry_after_ms double")
    got = [(r.decision, r.wait_ms) for r in machines.retry_ladder(df, "doc", ["ord"]).orderBy("ord").collect()]
    assert got[:4] == [("retry", 1000), ("retry", 2000), ("retry", 4000), ("done", None)] and [g[0] for g in got[4:]] == ["given up"] * 5 + ["document ends", "skipped"]
    steps = [(0, "start", False), (1, "error", False), (2, "start", False), (20_001, "start", False), (20_002, "error", False), (90_000, "start", False), (90_001, "error", False), (90_002, "cancel", False)]
    df = spark.createDataFrame([("d", i, *s) for i, s in enumerate(steps)], "doc string, ord int, t_ms long, outcome string, permanent boolean")
    got = [(r.status, r.attempts) for r in machines.job_lifecycle(df, "doc", ["ord"]).orderBy("ord").collect()]
    assert got == [("processing", 0), ("retrying", 1), ("retrying", 1), ("processing", 1), ("retrying", 2), ("processing", 2), ("failed", 3), ("failed", 3)]


def test_logs(spark):
    df = spark.createDataFrame([("d", i, f"e{i}") for i in range(1, 11)], "doc string, seq long, message string")
    assert [r.seq for r in events.after(df, "doc", 1, 2).orderBy("seq").collect()] == [2, 3] and [r.seq for r in events.after(df, "doc", 0, 2).orderBy("seq").collect()] == [9, 10]
    assert [r.seq for r in events.retain(df, "doc", 8, 4).orderBy("seq").collect()] == [1, 8, 9, 10]
    pushed = spark.createDataFrame([("d", 10, "new"), ("d", 11, "e11")], df.schema)
    assert {r.seq: r.message for r in events.merge(df, pushed, "doc", 3).collect()} == {9: "e9", 10: "new", 11: "e11"}


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, "plain text", 10.0, 10.0, 60.0, 60.0), (1, 1, "title", 40.0, 40.0, 90.0, 90.0), (1, 2, "figure", 50.0, 50.0, 55.0, 55.0)], "page int, box_idx int, name string, x0 double, y0 double, x1 double, y1 double")
    boxes = boxes.withColumns({"page_w": F.lit(100), "page_h": F.lit(100)})
    chars = spark.createDataFrame([(1, 0, 20.0, 80.0), (1, 1, 45.0, 55.0), (1, 2, 52.0, 47.0), (1, 3, 1.0, 1.0)], "page int, char_id int, x double, y double").withColumns({"page_w": F.lit(100), "page_h": F.lit(100)})
    assert {r.char_id: r.cls for r in layout.box_classes(chars, boxes, ["page"]).collect()} == {0: 2, 1: 3, 2: 0, 3: 1}
    half = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 100.0), (1, 0.0, 0.0, 50.0, 100.0)], "page int, x0 double, y0 double, x1 double, y1 double").withColumns({"page_w": F.lit(100), "page_h": F.lit(100)})
    assert layout.coverage(half, ["page"]).first().coverage == 0.5
    parted = layout.separate_overlaps(spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 12.0), (1, 1, 0.0, 8.0, 10.0, 20.0)], "page int, b int, x0 double, y0 double, x1 double, y1 double"), "page", "b").orderBy("b").collect()
    assert (parted[0].y1, parted[1].y0) == (9, 11)


@pytest.mark.parametrize(("gaps", "want"), [([], 1.0), ([0.5], 1.0), ([3.0, 3.0], 3.0), ([5.0, 2.0, 4.0], 4.0)])
def test_second_gap(spark, gaps, want):
    assert spark.range(1).select(layout.second_gap(F.lit(gaps).cast("array<double>") if gaps else F.array().cast("array<double>"))).first()[0] == want


def test_similarity():
    a = np.random.default_rng(1).integers(0, 256, (20, 30))
    assert layout.ssim(a, a) == pytest.approx(1) and layout.ssim(a, 255 - a) < 0
    with pytest.raises(ValueError):
        layout.ssim(a[:5], a[:5])


def test_votes(spark):
    pages = spark.createDataFrame([("one", 0, True), *[("ten", i, i < 8) for i in range(10)], *[("few", i, i > 2) for i in range(10)]], "doc string, page int, yes boolean")
    got = {r.doc: (r.scanned, r.checked) for r in layout.scan_vote(pages, ["doc"], "page", F.col("yes")).collect()}
    assert got == {"one": (False, 0), "ten": (True, 8), "few": (False, 2)}


def test_replies(spark):
    why = lambda a, b: spark.range(1).select(replies.rejected_because(F.lit(a), F.lit(b).cast("string"))).first()[0]
    long = " ".join(f"w{i}" for i in range(30))
    assert [why("a b", None), why(long, long), why("", "x"), why("a", "b c d e"), why(long, long[:-1] + "x"), why("a b", "c d")] == ["missing", "unchanged", "empty source", "length", "hardly changed", None]
    df = spark.createDataFrame([('[{"id": 0, "output": "x"}, {"id": "1", "input": "y"}]', 2), ('{"id": 0, "output": "x"}', 1), ('[{"id": 5, "output": "x"}]', 1), ("oops", 1)], "r string, n int")
    assert [None if r["items"] is None else [i.output for i in r["items"]] for r in replies.batch_items(df, "r", F.col("n")).collect()] == [["x", "y"], ["x"], None, None]


def test_in_order_matches(spark):
    starts = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate([0, 10, 20, 5])], "page int, seq int, x double, y double")
    ops = spark.createDataFrame([(1, i, float(x), 0.5) for i, x in enumerate([0, 5, 10, 20])], "page int, seq int, x double, y double")
    assert [(r.seq, r.op_seq) for r in segments.match_in_order(starts, ops, "page").orderBy("seq").collect()] == [(0, 0), (1, 2), (2, 3)]


def test_files(spark, tmp_path):
    for name, body in {"a": '{"id": "a", "status": "queued", "progress": 1}', "b": "{broken", "c": '{"id": "c", "status": "odd", "progress": 1}'}.items():
        (tmp_path / "lib" / name).mkdir(parents=True)
        (tmp_path / "lib" / name / "manifest.json").write_text(body)
        (tmp_path / "lib" / name / "events.jsonl").write_text('{"seq": 1, "stage": "inspect", "level": "info", "message": "m"}\n\n{oops\n')
    good, bad = library.read_manifests(spark, str(tmp_path / "lib"))
    assert [r.id for r in good.collect()] == ["a"] and bad.count() == 2
    good, bad = library.read_events(spark, str(tmp_path / "lib"))
    assert sorted(r.doc_id for r in good.collect()) == ["a", "b", "c"] and bad.count() == 3
    (tmp_path / "g.csv").write_bytes('﻿source,target,tgt_lng\r\n"a, ""b""",x,\r\nc,y,zh-CN\r\nd,z,fr\r\n'.encode())
    got = library.read_glossaries(spark, str(tmp_path / "g.csv"), "zh_cn").collect()
    assert [(r.name, r.source, r.target) for r in got] == [("g", 'a, "b"', "x"), ("g", "c", "y")]
    (tmp_path / "s.json").write_text("{not json")
    assert library.read_settings(spark, str(tmp_path / "s.json"), "n int", {"n": 4}).first().n == 4
    (tmp_path / "s.json").write_text('{"n": 7}')
    assert library.read_settings(spark, str(tmp_path / "s.json"), "n int", {"n": 4}).first().n == 7


def test_catalog(spark):
    docs = spark.createDataFrame([(1, "A b", "x.pdf", "queued", "received", 5), (2, "b", "a.pdf", "completed", "done", 7), (3, "c", "z.pdf", "failed", "inspect", 7)], "id long, title string, filename string, status string, stage string, created_at int")
    assert [r.id for r in catalog.list_documents(docs, "all", " A  B ").collect()] == [2, 1] and [r.id for r in catalog.list_documents(docs).collect()] == [3, 2, 1]
    assert catalog.count_documents(docs).first().asDict() == {"all": 3, "active": 1, "completed": 1, "failed": 1}


def test_stream_is_resumed(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda lo, hi: spark.createDataFrame([(i % 3, i, i * 1000, o, False) for i, o in zip(range(lo, hi), ["start", "start", "start", "error", "done", "recover"] * 9)], "user_id long, seq long, t_ms long, outcome string, permanent boolean")
    for lo, hi in ((0, 6), (6, 12)):
        rows(lo, hi).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows(0, 1).schema).parquet(source)
        query = logs.lifecycle(stream).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
        query.awaitTermination()
    last = {r.user_id: (r.status, r.attempts) for r in spark.read.parquet(out).orderBy("batch").collect()}
    want = machines.job_lifecycle(rows(0, 12), "user_id", ["seq"]).orderBy("seq").collect()
    assert last == {r.user_id: (r.status, r.attempts) for r in want}
