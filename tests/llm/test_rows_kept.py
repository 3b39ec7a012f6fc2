"""No operator changes a row of its input, whatever types and repeats it has; repeated words and rows cost no more than others."""

import decimal
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import chat, codes, decontaminate, exact_dedup, fingerprints, jaccard, line_dedup, packing, phrases, quality, sharding, toxicity
from tests.llm.test_search_pack_warc import plain_hits

BIG = (1 << 60) + 1
EXTRA = "t timestamp, d decimal(38,10), m map<string,int>, b binary, f double, s struct<x:long,y:string>"


def rows(ids):
    at = datetime(2026, 1, 1)
    out = []
    for k in range(60):
        extra = (at + timedelta(microseconds=k % 7), decimal.Decimal(f"{k}.0000000001"), {"k": k % 3} if k % 4 else None, bytes([k]), float(k) if k % 5 else None, (BIG + k, None) if k % 2 else (None, str(k)))
        out.append((ids[k % len(ids)], None if k % 11 == 0 else f"l{k % 9}\nsame\nlines\nhere too {k % 6}", *extra))
    return out + out[:5]


def shown(r, columns):
    return repr([sorted(v.items()) if isinstance(v, dict) else bytes(v) if isinstance(v, bytearray) else v for v in (r[c] for c in columns)])


@pytest.mark.parametrize(("kind", "ids"), [("string", ["x", None, "", "ü", "9007199254740993"]), ("long", [BIG, None, BIG + 1, -BIG, 3])])
def test_rows_stay_what_they_are(spark, kind, ids):
    docs = spark.createDataFrame(rows(ids), f"doc_id {kind}, text string, {EXTRA}")
    bench = spark.createDataFrame([(1, "same lines here")], "item_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1, 0)], f"doc_id {kind}, low_quality int, toxic int")
    no_text = [c for c in docs.columns if c != "text"]
    want, bare = Counter(shown(r, docs.columns) for r in docs.collect()), Counter(shown(r, no_text) for r in docs.collect())
    made = {
        "op1": exact_dedup.exact_dedup(docs), "op2": quality.train_quality(docs, labels, label_col="toxic").score(docs), "op3": toxicity.train_toxicity(docs, labels, ["low_quality", "toxic"]).score(docs),
        "op6": sharding.shuffle_shards(docs, shards=2, bucket_rows=4), "op7": decontaminate.find_contamination(docs, bench), "op11": fingerprints.fingerprints(docs),
    }
    for name, df in made.items():
        assert Counter(shown(r, docs.columns) for r in df.collect()) == want, name
    assert Counter(shown(r, no_text) for r in line_dedup.line_dedup(docs).collect()) == bare
    packed = packing.pack(docs, F.lit(7))
    assert Counter(r.doc_id for r in packed.collect()) == Counter(r[0] for r in rows(ids))
    assert Counter(r.doc_id for r in jaccard.jaccard_join(docs).collect()) == Counter(r[0] for r in rows(ids))
    vectors = docs.select("*", F.array(*[F.lit(float(k)) for k in range(8)]).alias("v"))
    assert Counter(shown(r, docs.columns) for r in codes.compress(vectors, "doc_id", "v")[0].collect()) == want
    assert phrases.mine(docs.withColumn("lang", F.lit(None).cast("string")), least=5).count() > 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert kept and not Counter(shown(r, docs.columns) for r in kept) - want


def test_shards_of_rows_whose_hashes_agree(spark):
    nulls = [("x", None)] * 40 + [(None, "x")] * 40
    got = sharding.shuffle_shards(spark.createDataFrame(nulls, "doc_id string, text string"), shards=3, bucket_rows=8).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(nulls)
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    same = sharding.shuffle_shards(spark.createDataFrame([("a", "b")] * 3000, "doc_id string, text string").repartition(5), shards=1, bucket_rows=16).collect()
    assert sorted(r.slot for r in same) == list(range(3000)) and max(Counter(r.bucket for r in same).values()) < 60


def test_conversations_of_odd_names_and_long_texts(spark):
    turns = spark.createDataFrame([("c", 0, "user", "u" * 2_000_000), ("c", 1, "assistant", "<|" * 300_000)], "`conv.id` string, `t.u` long, `r.o` string, `te.xt` string")
    back = chat.read_back(chat.expand_targets(turns, "conv.id", "t.u", "r.o", "te.xt")).first()
    assert [len(t.text) for t in back.turns] == [2_000_000, 600_000] and back.losses[0].text == "<|" * 300_000


def words(n, word="same"):
    return " ".join([word] * n)


def test_repeated_words_take_linear_time():
    for item, text in [(words(20_000), words(200_000)), (words(20_000, "a b c d e f g"), words(30_000, "a b c d e f g")), (words(12), words(200_000))]:
        began = time.time()
        matcher = decontaminate.Matcher([("1", decontaminate.words_of(item))], 13)
        own = decontaminate.words_of(text)
        assert matcher.find(own) == ([(0, len(own))], ["1"])
        assert time.time() - began < 10


def test_matcher_against_plain():
    import random

    r = random.Random(4)
    for trial in range(60):
        vocabulary = "ab" if trial % 2 else "abcdefgh"
        items = [(str(k % 5), " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 5, 12, 13, 14, 40])))) for k in range(8)]
        text = " ".join(r.choice(vocabulary + "z") for _ in range(60)) + " " + items[0][1] + " z " + items[1][1][4:]
        ranges, found = decontaminate.Matcher([(i, decontaminate.words_of(t)) for i, t in items], 13).find(decontaminate.words_of(text))
        _, hits, names = plain_hits(text, items)
        assert (sum(b - a for a, b in ranges), found) == (hits, names) and ranges == decontaminate.merged(ranges)


def test_many_equal_rows_beside_a_near_copy(spark):
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:99], "other"])
    many = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(" ".join(base)).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(2, near), (3, "alone in the world of words")], "doc_id long, text string"))
    got = jaccard.jaccard_join(docs).groupBy("doc_id", "class_id", "n_links", "n_copies").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 200_000, 200_000, 200_000, 1), (2, 1, 200_000, 1, 1, 0), (3, 3, 0, 1, 1, 1)}
    lines = docs.select("doc_id", F.concat(F.lit("a\nb\nc\n"), "text").alias("text"))
    cut = line_dedup.line_dedup(lines).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in cut} == {(1, 0, 200_000), (2, 3, 1), (3, 3, 1)}
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 2
