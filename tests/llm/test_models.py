import zlib

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import queries
from parchment.llm.linear import Features, Ftrl, margins, sigmoid
from parchment.llm.quality import train_quality
from parchment.llm.textnum import WORDS, word_hashes
from parchment.llm.toxicity import train_toxicity

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int, low_quality int"


def test_word_hashes_depend_on_the_word_alone():
    texts = [b"a bb a", b"", b"bb, a", b"x" * 5000 + b" a"]
    h, first, _ = word_hashes(texts, WORDS)
    assert first.tolist() == [0, 3, 3, 5, 7]
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_margins_are_sparse_dot_products():
    f, texts = Features(bits=10), ["a b a b", "", "A !! b", "a " * 9]
    w = np.random.default_rng(1).normal(size=1025).astype(np.float32)
    want = [float(w[at] @ x + w[-1]) for at, x in f.rows(texts)]
    assert np.allclose(margins(f, w, texts), want, atol=1e-4)


def test_ftrl_learns():
    f = Features(bits=12)
    texts = [f"good w{i} text" if i % 2 else f"bad w{i} text" for i in range(200)]
    y = np.arange(200) % 2
    p = sigmoid(margins(f, Ftrl(1 << 12, alpha=2).fit(f.rows(texts), y), ["a good one", "a bad one"]))
    assert p[0] > 0.7 and p[1] < 0.3


def test_quality_on_held_out(spark):
    got = queries.op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.98
    assert got["score"].between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.head(50).itertuples())


def test_toxicity_on_held_out(spark):
    got = queries.op3_toxicity(spark, SF).withColumnRenamed("toxic", "found").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    caught, wrong = held[held["toxic"] == 1]["found"].mean(), held[held["toxic"] == 0]["found"].mean()
    assert caught > 0.85 and wrong < 0.02


def test_models_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "fine words here", "x"), (None, "bad", "x"), (3, "fine words here", "x")], DOCS)
    labels = spark.createDataFrame([(3, 1, 0, 0), (2, None, None, None), (9, 0, 1, 1), (3, 1, 0, 0)], LABELS)
    got = train_quality(docs, labels).score(docs).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in train_quality(docs, none).score(docs).collect()} == {0.5}
    assert train_quality(docs, labels).score(docs.limit(0)).count() == 0
    chain = train_toxicity(docs, labels, ["low_quality", "toxic"])
    assert chain.score(docs).columns == [*docs.columns, "p_low_quality", "low_quality", "p_toxic", "toxic"]
    assert chain.score(docs).count() == 5
    assert {r.p_toxic for r in train_toxicity(docs, none, ["toxic"]).score(docs).collect()} == {0.5}


def test_chain_uses_earlier_categories(spark):
    rows = [(i, f"{'junk' if i % 2 else 'prose'} word{i}", "") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("low_quality"))
    chain = train_toxicity(docs, labels, ["low_quality", "toxic"])
    assert chain.weights[1][(1 << chain.features.bits)] > 0
    assert chain.probabilities(["junk a", "prose a"])[:, 1].round().tolist() == [1, 0]
