import hashlib
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import fingerprints, queries

SF = "/root/testdata/sf0.001"


def xx(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v) if isinstance(v, int) else v.encode(), seed)
    return seed


def plain(text):
    """The two arrays of a text's vector, added up paragraph by paragraph."""
    exact, sketch = [0] * fingerprints.LANES, [0] * fingerprints.SKETCH
    for p in (text or "").split("\n"):
        digest = hashlib.sha256(p.encode()).hexdigest()
        exact = [(x + (xx(k, digest) >> 32)) % (1 << 32) for k, x in enumerate(exact)]
        words = p.split(" ") if p else []
        for i in range(len(words)):
            code = xx(*words[i : i + 3]) % (2 * fingerprints.SKETCH)
            sketch[code // 2] += 1 - 2 * (code % 2)
    return exact, sketch


def digits(vector):
    return "".join(f"{x % (1 << 32):08x}" for x in vector[0]) + "".join(f"{x % (1 << 24):06x}" for x in vector[1])


def like(v, w):
    if v == w:
        return 1.0
    square = lambda x: sum(y * y for y in x)
    n = square(v[1]) + square(w[1])
    return max(0.0, 1 - square([a - b for a, b in zip(v[1], w[1], strict=True)]) / n) if n else 0.0


def test_query_against_plain_python(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in queries.op11_fingerprints(spark, SF).collect()}
    assert sorted(got) == sorted(docs)
    better = 0
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, k = docs[i], len(docs[i]) // 3
        edited = text[: len(text) - k] + docs[after][:k]
        r, own, changed = got[i], plain(text), plain(edited)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digits(own), digits(changed))
        assert r.near_edited == pytest.approx(like(own, changed)) and r.near_next == pytest.approx(like(own, plain(docs[after])))
        better += r.near_edited > r.near_next
    assert better > 0.95 * len(ids)
    assert len({r.fingerprint for r in got.values()}) == len({tuple(sorted(Counter(t.split("\n")).items())) for t in docs.values()})


def test_order_insertion_and_deletion(spark):
    rows = [("a b c\nd e", "d e\na b c", "a b c", "d e"), ("\n\n", "\n\n", "\n", ""), ("ü\x00x\nü\x00x", "ü\x00x\nü\x00x", "ü\x00x", "ü\x00x")]
    fp = lambda c: fingerprints.fingerprint(F.col(c))
    df = spark.createDataFrame(rows, "both string, turned string, one string, other string").select(*[fp(c).alias(c) for c in ("both", "turned", "one", "other")])
    both, one, other = F.col("both"), F.col("one"), F.col("other")
    got = df.select("both", "turned", "one", fingerprints.inserted(one, other).alias("added"), fingerprints.deleted(both, other).alias("less"), fingerprints.deleted(both, both).alias("none"), fingerprints.likeness(both, one).alias("near"), fingerprints.likeness(both, both).alias("same")).collect()
    for r in got:
        assert r.both == r.turned == r.added and r.less == r.one and r.none == fingerprints.NOTHING and r.same == 1
        assert r.both != r.one and 0 <= r.near < 1


def test_odd_texts_and_names(spark):
    long = " ".join(["w"] * 200_000)
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, long, "x"), (None, long, "x")], "doc_id long, `the.text` string, fingerprint string")
    got = fingerprints.fingerprints(docs, "the.text").collect()
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint == got[3].fingerprint
    assert fingerprints.fingerprints(docs.limit(0), "the.text").count() == 0 and fingerprints.fingerprints(docs, "the.text").columns == ["doc_id", "the.text", "fingerprint"]


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_next(spark, ranges):
    plain_rows = [(k * 3 % 101, f"t{k}") for k in range(101)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "greatest")]
    rows = [*plain_rows, (None, "n"), (50, "again"), *[(7, "copy")] * 40, (None, None)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ranges=ranges).collect()
    assert Counter((r.id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)
    assert Counter(r.next_text for r in got) == Counter(t or "" for _, t in rows)  # each follows one
    follow = Counter((r.id, r.text, r.next_text) for r in got)
    assert follow[7, "copy", "copy"] >= 39
    ids = sorted({i for i, _ in plain_rows}, reverse=True)
    texts = {i: {t or "" for j, t in rows if j == i} for i in {j for j, _ in rows}}
    for r in got:
        if r.id not in (None, -(1 << 63), 0):  # the least id and null are in order of their texts
            assert r.next_text in texts[r.id] | texts[ids[ids.index(r.id) + 1]]
    one = fingerprints.with_next(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), ranges=ranges).collect()
    assert [(r.text, r.next_text) for r in one] == [("x y", "x y")]
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"), ranges=ranges).count() == 0
