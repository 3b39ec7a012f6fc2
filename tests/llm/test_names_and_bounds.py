"""Column names that clash, rows that repeat, texts that are long, and bounds that hold."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import decontaminate, exact_dedup, jaccard, line_dedup, packing, quality, sharding, toxicity, warc
from parchment.llm.common import join_groups
from parchment.llm.linear import Features, Ftrl
from tests.llm.test_dedup import plain_join, plain_line_dedup

NAMES = ["best", "__text", "__cuts", "__id", "__all", "__new", "__p", "__salt", "__group", "__heavy", "heavy", "light", "salt", "group", "row", "ROW_", "at", "len", "prefix", "cell", "id", "hit", "hits", "copy", "a.b", "x`y", "Kind"]
TEXTS = ["same text", "same  text", None, "", "l1\nl2\nl3\nown", "x\nl1\nl2\nl3", "w " * 40, "long " * 400_000]


@pytest.fixture(scope="module")
def odd(spark):
    more = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, *[f"{n}{i}" for n in NAMES], {"k": i}) for i, t in enumerate(TEXTS)], f"doc_id long, text string, {more}, m map<string,int>").cache()


def extras(row):
    return tuple(row[n] for n in NAMES) + (row["m"],)


def test_no_name_is_lost_or_changed(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, low_quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    made = [
        exact_dedup.exact_dedup(odd), line_dedup.line_dedup(odd), sharding.shuffle_shards(odd, shards=2, bucket_rows=2), decontaminate.find_contamination(odd, bench), decontaminate.find_contamination(odd, bench, block_bytes=1),
        toxicity.train_toxicity(odd, labels, ["low_quality", "toxic"]).score(odd), quality.train_quality(odd, labels, label_col="toxic").score(odd),
    ]
    want = {r.doc_id: extras(r) for r in odd.collect()}
    for df in made:
        assert df.columns[: len(odd.columns)] == odd.columns
        assert {r.doc_id: extras(r) for r in df.collect()} == want
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_duplicates):
        got = stage(spark, odd, "")
        assert got.columns == odd.columns and all(extras(r) == want[r.doc_id] for r in got.collect())


def test_join_groups_takes_any_names(spark):
    rows = spark.createDataFrame([(k % 5, k, "s", "g", "h", "l") for k in range(200)], "key long, n long, salt string, group string, heavy string, `a.b` string")
    groups = spark.createDataFrame([(k, 40, f"v{k}") for k in range(4)], "key long, size long, `__group` string")
    got = join_groups(rows, groups, ["key"], "size", F.col("n")).collect()
    assert len(got) == 200 and all((r.salt, r.group, r.heavy, r["a.b"]) == ("s", "g", "h", "l") and r["__group"] == (f"v{r.key}" if r.key < 4 else None) for r in got)


def test_lengths_come_first(spark):
    texts = ["a" * n for n in range(1, 40)] + ["b" * 5, "a" * 5, "c" * 200 + "x", "c" * 200 + "y", "c" * 200 + "x"]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (texts.index(t), texts.count(t)) for i, t in enumerate(texts)}


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(i, "x" * 100) for i in range(2, 40)] + [(99, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(1, 40), 99]], "doc_id long, quality int")
    draw = lambda rows, size: quality.labelled_sample(docs, labels, ["quality"], "doc_id", "text", rows, size).collect()
    assert len(draw(10, 1 << 20)) == 10 and len(draw(1000, 1 << 20)) == 40
    assert len(labels.filter("doc_id = 1").collect()) == 1 == len(quality.labelled_sample(docs, labels.filter("doc_id = 1"), ["quality"], "doc_id", "text", 10, 1 << 20).collect())
    few = draw(1000, 64 * 120)
    assert len(few) == 39 and max(len(r.text) for r in few) == 100
    assert sum(len(r.text) for r in quality.labelled_sample(docs, labels, ["quality"], "doc_id", "text", 1000, 64 * 100 - 3000).collect()) <= 3400
    assert draw(1000, 64 * 120) == few


def test_ftrl_equals_a_plain_loop():
    rng, dim = np.random.default_rng(2), 64
    rows = [(np.sort(rng.choice(dim, 5, replace=False)), rng.random(5)) for _ in range(60)]
    y = rng.integers(0, 2, 60).astype(float)
    alpha, beta, l1, l2, z, n, order = 0.7, 1.0, 0.02, 0.1, [0.0] * (dim + 1), [0.0] * (dim + 1), np.random.default_rng(7)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(4):
        for r in order.permutation(60):
            x = dict(zip([*rows[r][0].tolist(), dim], [*rows[r][1].tolist(), 1.0], strict=True))
            p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in x.items())))
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y[r]) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    got = Ftrl(dim, alpha=alpha).fit(rows, y)
    assert np.allclose(got, [weight(i) for i in range(dim + 1)], atol=1e-6)


def test_long_and_odd_texts_have_scores(spark, odd):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    none = odd.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a null id").alias("text"))
    scored = quality.train_quality(odd, labels).score(odd.select("doc_id", "text").unionByName(none)).collect()
    assert len(scored) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in scored)
    assert Features().rows(["long " * 400_000])[0][1].max() > 1


def spark_hash(*values):
    """xxhash64 as Spark has it: ints in four bytes, longs in eight, each value seeded with the hash before it."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes({"int": 4, "long": 8}[kind], "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


def test_shards_are_those_of_plain_rendezvous(spark):
    got = sharding.shuffle_shards(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()
    best = lambda d, n: max((spark_hash(("int", 20), ("int", k), ("long", d)), k) for k in range(n))[1]
    assert all((r.shard, r.grown_shard) == (best(r.doc_id, 16), best(r.doc_id, 17)) for r in got)


def test_slots_depend_on_seed_and_rows_alone(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    place = lambda df, **more: {(r.doc_id, r.shard, r.bucket, r.slot) for r in sharding.shuffle_shards(df, shards=2, bucket_rows=20, **more).collect()}
    first = place(docs)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert place(docs.repartition(7).orderBy(F.desc("doc_id"))) == first
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert place(docs, seed=21) != first


def test_equal_rows_are_scattered(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(10, 60).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    got = sharding.shuffle_shards(rows, shards=3, bucket_rows=100).collect()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    held = defaultdict(int)
    for r in got:
        held[r.shard, r.bucket] += 1
    assert len(got) == 3050 and sum(r.text == "same" for r in got) == 3000 and max(held.values()) < 500


def test_fisher_yates_is_uniform(spark):
    four = F.sequence(F.lit(1), F.lit(4))
    got = spark.range(12_000).select(sharding.fisher_yates(four, F.lit(4), lambda i: F.xxhash64("id", i)).alias("p")).groupBy("p").count().collect()
    assert len(got) == 24 and all(400 < r["count"] < 600 for r in got)


def plain_pool(sizes, lengths):
    """The cheapest of the best fits that open bins of at least each length: cost, and contents of the bins."""
    cost = lambda n: n + n * n / 65536 + 16
    plans = []
    for least in lengths:
        bins = []
        for size in sorted(sizes, reverse=True):
            fits = [b for b in bins if b[0] - b[1] >= size]
            if fits:
                min(fits, key=lambda b: b[0] - b[1])[1] += size
            else:
                able = [n for n in lengths if n >= size and n >= least] or [n for n in lengths if n >= size]
                bins.append([min(able, key=lambda n: (cost(n) / n, n)), size])
        held = [min(n for n in lengths if n >= b[1]) for b in bins]
        plans.append((sum(map(cost, held)), sorted(zip(held, [b[1] for b in bins], strict=True))))
    return min(plans, key=lambda p: p[0])


def test_pools_take_the_cheapest_joint_choice(spark):
    rng, lengths = np.random.default_rng(4), (16, 32, 64, 128)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 129, 900))]
    pools = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), F.col("n"), lengths=lengths, pool_rows=300).collect():
        pools[r.bin.split("-")[0]].append(r)
    assert len(pools) == 3
    for held in pools.values():
        want = plain_pool([r.n_tokens for r in held], lengths)
        assert sorted({r.bin: (r.bin_length, r.bin_tokens) for r in held}.values()) == want[1]


def test_equal_rows_are_in_several_pools(spark):
    got = packing.pack(spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(700).alias("n")), F.col("n"))
    pools = got.groupBy(F.substring_index("bin", "-", 1).alias("pool")).count().collect()
    assert len(pools) == 7 and max(r["count"] for r in pools) < 9500 and sum(r["count"] for r in pools) == 60_000


def test_links_near_the_threshold_are_found_in_deep_trees(spark):
    rng, texts = np.random.default_rng(8), {}
    for k in range(200):
        words = [f"v{rng.integers(1 << 30)}" for _ in range(300)]
        other = list(words)
        for at in range(5, 300, 58):  # each changed word takes five shingles with it
            other[at] = f"u{rng.integers(1 << 30)}"
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(other)
    want = plain_join(texts)
    assert sum(n for _, n in want.values()) == 400
    got = jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), leaf_sets=4)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == want


def test_dense_cluster_in_blocks(spark):
    rng, base = np.random.default_rng(9), [f"w{i}" for i in range(200)]
    texts = {}
    for k in range(300):
        words = list(base)
        for at in rng.choice(200, rng.integers(0, 5), replace=False):
            words[at] = f"z{rng.integers(50)}"
        texts[k] = " ".join(words)
    got = jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), leaf_sets=32, block_sets=64)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == plain_join(texts)


def test_many_cuts_take_linear_time(spark):
    n = 60_000
    rows = [(k, "\n".join(f"a{i}\nb{i}\nc{i}\n{k} {i}" for i in range(n))) for k in range(2)]
    got = {r.doc_id: (r.n_removed, r.n) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", F.size("removed").alias("n")).collect()}
    assert got == {0: (0, 0), 1: (3 * n, n)}


def test_adjacent_and_overlapping_covers(spark):
    texts = {1: "a\nb\nc\nd\ne\nf", 2: "a\nb\nc\nd\ne\nf\ng", 3: "x\na\nb\nc\n\nd\ne\nf\ny\na\nb\nc\nz", 4: "a\nb\nc", 5: "q\na\nb\nc\na\nb\nc\nr"}
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {d: r.text for d, r in got.items()} == plain_line_dedup(texts)
    assert [tuple(c) for c in got[3].removed] == [(1, 7), (9, 11)] and [tuple(c) for c in got[5].removed] == [(1, 6)]


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_items_longer_than_a_segment(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate.segments, "__defaults__", (40,))
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words[20:60])), (2, "p " * 5 + " ".join(words[100:113])), (3, " ".join(words[100:112])), (4, None), (4, None), (5, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[105:140])), (None, "w298 w299")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect())
    assert got == [(1, 40, 40, ["1"]), (2, 18, 13, ["1"]), (3, 12, 0, []), (4, 0, 0, []), (4, 0, 0, []), (5, 300, 300, ["1", "2", "None"])]


def foreign(kind, block, digest=None, payload=None, name=str, more=""):
    head = f"WARC/1.0\r\n{name('WARC-Type')}:{kind}\r\n{name('Content-Length')}:   {len(block)}\r\n{name('WARC-Record-ID')}: <urn:uuid:1>\r\n{more}"
    head += f"{name('WARC-Block-Digest')}:{digest}\r\n" if digest else ""
    head += f"{name('WARC-Payload-Digest')}:{payload}\r\n" if payload else ""
    return warc.gzip_member(f"{head}\r\n".encode() + block + b"\r\n\r\n")


def test_reader_takes_foreign_records(spark):
    page, http = b"<p>hello</p>", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hello</p>"
    sha = lambda b: "sha1:" + hashlib.sha1(b).hexdigest()
    kind = "content-type: application/http;msgtype=response\r\n"
    raw = [
        foreign("warcinfo", b"software: x\r\n"), foreign("response", http, sha(http).upper().replace("SHA1", "sha1"), sha(page), str.lower, kind), foreign("revisit", b"HTTP/1.1 304 x\r\n\r\n", payload=sha(page), name=str.upper, more=kind),
        foreign("response", http, sha(b"other"), more=kind), foreign("metadata", b"a\r\n\r\nb", sha(b"a\r\n\r\nb"), more="X-Long: one\r\n  two\r\n"), foreign("response", b"HTTP/1.1 200 OK\r\n" + b"H: v\r\n" * 50_000, more=kind),
        foreign("response", http, "md5:abc", "sha1:!", more=kind),
    ]
    got = list(warc.read_records([b"".join(raw)]))
    assert [r["payload_bytes"] for r in got] == [13, 12, 0, 12, 6, 0, 12]
    assert [r["verified"] for r in got] == [None, True, None, False, True, None, None]
    assert got[2]["payload_digest"] == hashlib.sha1(page).hexdigest() and got[4]["headers"]["X-Long"] == "one two"
    pieces = spark.createDataFrame([(1, 0, b"".join(raw)[:100]), (1, 1, b"".join(raw)[100:]), (None, 3, b"x"), (2, 0, raw[0])], "archive long, chunk int, data binary")
    assert warc.read_archives(pieces).count() == 8


def test_archives_are_rolled(spark):
    pages = spark.range(60).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") > 0, F.sha2(F.col("id").cast("string"), 512)).otherwise(F.lit("z" * 3_000_000)).alias("html"))
    pieces = warc.write_archives(pages, chunk_bytes=300, archive_bytes=2000)
    sizes = [r.n for r in pieces.groupBy("archive").agg(F.sum(F.octet_length("data")).alias("n")).collect()]
    assert len(sizes) > 5 and sorted(r.page for r in warc.read_archives(pieces).collect()) == sorted(map(str, range(60)))
    assert all(r.verified for r in warc.read_archives(pieces).collect())


def test_pipeline_on_odd_tables(spark, tmp_path):
    rows = [(1, "a fine text " * 30, "en", "s", 9, "x"), (1, "a fine text " * 30, "en", "s", 9, "x"), (None, None, None, None, None, None), (None, None, None, None, None, None), (2, "", "en", "s", 0, "x"), (3, "word " * 300_000, "en", "s", 1, "x"), (4, "l1\nl2\nl3\nl4", None, None, None, "x"), (5, "l1\nl2\nl3\nl5", "en", "s", 5, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string"
    for name, data in (("some", rows), ("none", [])):
        out = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(out / "documents.parquet"))
        spark.createDataFrame([(9, 1, 0), (None, None, None)] if data else [], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
        spark.createDataFrame([(1, "word word"), (2, None)] if data else [], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "some/documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.write_table(stage(spark, docs, str(tmp_path / "some")), "odd")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        seen.append(sorted((r.doc_id or 0) for r in docs.collect()))
    assert seen == [[0, 0, 1, 1, 2, 3, 4, 5], [0, 0, 1, 2, 3, 4, 5], [0, 0, 1, 2, 4, 5]]
    assert {r.doc_id: (r.text, r.removed) for r in docs.collect()}[5] == ("l5", "x")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() > 0
