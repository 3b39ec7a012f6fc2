"""Both classifiers against plain Python: features word by word, updates in a loop, folds, chain and thresholds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import quality, toxicity
from parchment.llm.linear import Features

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def word_hash(word):
    return mix((sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word)) & M)


def plain_features(text, spec):
    """Index and value of each feature of a text: words (and signs), pairs, repeated words, and how long words begin."""
    coded = (text.lower() if spec.fold else text).encode()
    shape = rb"[0-9A-Za-z\x80-\xff]+" + (rb"|[!-/:-@\[-`{-~]+" if spec.signs else b"")
    words = re.findall(shape, coded)
    found = [word_hash(w) for w in words]
    out = list(found)
    if spec.pairs:
        for a, b in zip(found, found[1:]):
            out.append(mix((a * 0xA24BAED4963EE407 + b) & M))
            if a == b:
                out.append(0x9FB21C651E98DF25)
    for n in spec.prefixes:
        out += [mix((word_hash(w[:n]) + n * 0xD6E8FEB86659FD93) & M) for w in words if len(w) > n]
    counts = Counter(h >> (64 - spec.bits) for h in out)
    return {i: n / math.sqrt(max(1, len(out))) for i, n in counts.items()}


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40, min(40, x))))


def plain_ftrl(rows, labels, alpha, l1, beta=1.0, l2=0.1, epochs=4):
    """rows: name of a feature to value; the bias is the feature None."""
    z, n, order = Counter(), Counter(), np.random.default_rng(7)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x = rows[r] | {None: 1.0}
            w = {i: weight(i) for i in x}
            gap = sigmoid(sum(w[i] * v for i, v in x.items())) - labels[r]
            for i, v in x.items():
                g = gap * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def dot(w, x):
    return sum(w.get(i, 0.0) * v for i, v in (x | {None: 1.0}).items())


def signed_hash(i):
    h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=42)
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="module")
def given():
    r = random.Random(9)
    calm, harsh = ["river", "garden", "morning light", "Quiet", "house", "café", "walk"], ["idiots", "IDIOTIC", "hateful", "worthless", "stupidest"]
    rows = []
    for k in range(200):
        low, toxic = k % 3 == 0, k % 5 == 0
        words = [r.choice(calm) for _ in range(r.randint(3, 25))] + ([r.choice(harsh)] * 2 if toxic else []) + (["buy buy!!", "$$$"] if low else [])
        r.shuffle(words)
        rows.append((k, " ".join(words), int(low), int(toxic)))
    return rows


@pytest.mark.parametrize("spec", [Features(), toxicity.FEATURES, Features(bits=10, pairs=True, signs=True, fold=True, prefixes=(2,))])
def test_features(given, spec):
    texts = [t for _, t, *_ in given[:40]] + ["", "!!", "a a a b", "é ßß 123_x", "x" * 50]
    for text, (at, x) in zip(texts, spec.rows(texts), strict=True):
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx(plain_features(text, spec))


def test_quality_scores(spark, given):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in given], "doc_id long, text string")
    labels = spark.createDataFrame([(k, low) for k, _, low, _ in given if k % 4], "doc_id long, quality int")
    model = quality.train_quality(docs, labels, usable=F.col("doc_id") % 7 != 0)
    used = sorted((x for x in given if x[0] % 4 and x[0] % 7), key=lambda x: signed_hash(x[0]))
    w = plain_ftrl([plain_features(x[1], Features()) for x in used], [x[2] for x in used], 2.0, 0.2)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert all(got[k] == pytest.approx(sigmoid(dot(w, plain_features(t, Features()))), abs=1e-5) for k, t, *_ in given)


def test_the_chain_its_folds_and_its_thresholds(spark, given):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in given], "doc_id long, text string")
    labels = spark.createDataFrame([(k, low, toxic) for k, _, low, toxic in given if k % 4], "doc_id long, low_quality int, toxic int")
    chain = toxicity.train_toxicity(docs, labels, ["low_quality", "toxic"])
    used = sorted((x for x in given if x[0] % 4), key=lambda x: signed_hash(x[0]))
    texts = [plain_features(x[1], toxicity.FEATURES) for x in used]
    fold = [signed_hash(x[0]) % 4 for x in used]
    early, final, thresholds = [{} for _ in used], [], {}
    for c, category in enumerate(["low_quality", "toxic"]):
        rows, y = [t | e for t, e in zip(texts, early, strict=True)], [x[2 + c] for x in used]
        out = [0.0] * len(used)
        for f in range(4):
            inside = [i for i in range(len(used)) if fold[i] != f]
            w = plain_ftrl([rows[i] for i in inside], [y[i] for i in inside], 5.0, 0.5)
            for i in range(len(used)):
                if fold[i] == f:
                    out[i] = sigmoid(dot(w, rows[i]))
        final.append(plain_ftrl(rows, y, 5.0, 0.5))
        f1 = {t / 20: 2 * sum(p >= t / 20 and l == 1 for p, l in zip(out, y, strict=True)) / max(1, sum(p >= t / 20 for p in out) + sum(y)) for t in range(1, 20)}
        thresholds[category] = max(t for t in f1 if f1[t] == max(f1.values()))
        early = [e | {("p", c): p} for e, p in zip(early, out, strict=True)]
    assert chain.thresholds == pytest.approx(thresholds)
    got = {r.doc_id: r for r in chain.score(docs).collect()}
    for k, text, *_ in given:
        x = plain_features(text, toxicity.FEATURES)
        first = sigmoid(dot(final[0], x))
        second = sigmoid(dot(final[1], x | {("p", 0): first}))
        assert (got[k].p_low_quality, got[k].p_toxic) == (pytest.approx(first, abs=1e-4), pytest.approx(second, abs=1e-4))
        if min(abs(first - thresholds["low_quality"]), abs(second - thresholds["toxic"])) > 1e-3:
            assert (got[k].low_quality, got[k].toxic) == (first >= thresholds["low_quality"], second >= thresholds["toxic"])
