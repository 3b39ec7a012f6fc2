"""Phrases at size: automata as arrays, prefix ranges by the number of words, and unions some arcs at a time."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parchment.llm import automata, phrases, textnum
from tests.llm.test_phrases import mined, plain, prefix_counts


def texts(n, seed=1, words=60):
    r = random.Random(seed)
    some = [f"w{k}" for k in range(words)] + ["ä", "x y", "\x00"]
    return [" ".join(r.choices(some, range(1, len(some) + 1), k=r.randint(0, 30))) + r.choice(["", ".", "\n a"]) for _ in range(n)]


def test_union_takes_a_fraction_of_plain_counting():
    r = random.Random(2)
    held = [sorted((tuple(b"%d" % r.randrange(300) for _ in range(4)), 1) for _ in range(5000)) for _ in range(24)]
    parts = [automata.build(own) for own in held]
    begun = time.process_time()
    want = Counter()
    for own in held:
        want.update(prefix_counts(own))
    counting, begun = time.process_time() - begun, time.process_time()
    both = automata.union(parts)
    assert time.process_time() - begun < counting / 2
    assert dict(both.prefixes()) == want


@pytest.mark.parametrize("share", [False, True])
def test_union_of_packed_parts(share):
    r = random.Random(3)
    held = [sorted((tuple(r.choice([b"a", b"b", b"\xc3\xa4", b"d"]) for _ in range(r.randint(1, 5))), r.choice([1, 300, 70_000, 5 << 32])) for _ in range(60)) for _ in range(9)]
    parts = [automata.Transducer.unpacked(automata.build(own).packed()) for own in held]
    some = [automata.Transducer.unpacked(automata.union(parts[k : k + 3], share=share).packed()) for k in range(0, 9, 3)]
    assert dict(automata.union(some).prefixes()) == prefix_counts(x for own in held for x in own)
    assert dict(automata.union([automata.build([])] * 2, 3).prefixes()) == {}


def test_equal_states_are_one():
    tails = [(b"x", b"y"), (b"x", b"z"), (b"y",)]
    trees = [automata.build([((b"%03d" % k, *t), 7) for t in tails]) for k in range(50)]
    both = automata.union(trees)
    assert len(both.states) == len(automata.build([((b"%03d" % k, *t), 7) for k in range(50) for t in tails]).states) < 10
    assert len(automata.union(trees, share=False).states) > 50


@pytest.mark.parametrize("top", [10, 1 << 20, (1 << 48) - 1, (1 << 64) - 1])
def test_distinct(top):
    r = np.random.default_rng(4)
    near = r.integers(0, min(top, 4000), 5000, dtype=np.uint64, endpoint=True)
    for keys in (near, np.uint64(top) - near, r.integers(0, top, 5000, dtype=np.uint64, endpoint=True), near[:1], near[:0]):
        found, first, number, n = textnum.distinct(keys)
        want = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip((found, first, number, n), want, strict=True)) and found.dtype == keys.dtype


def test_trees_of_chunks(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 700)
    monkeypatch.setattr(phrases, "BLOCK", 500)
    rows = [(t, lang) for lang in ("en", "f", "ü b") for t in texts(60, len(lang))]
    batch = pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows]), pa.array([x[0] for x in rows])], ["lang", "text"])
    got, chunks = {}, [b for out in phrases._chunked(iter([batch])) for b in out.column("blob").to_pylist()]
    for blob in chunks:
        keys = np.unique(phrases._all_keys(phrases._read(blob)))
        at = np.searchsorted(keys, phrases._bounds(3))
        marks = [{"bucket": b, "bits": np.packbits(np.ones(at[b + 1] - at[b], bool)).tobytes()} for b in range(3)]
        for r, tree in phrases._trees(blob, marks, 3, 11, 4):
            got.setdefault(r, []).append(tree)
    assert len(chunks) > 3 and len(got) == 11
    counts = Counter()
    for r, trees in got.items():
        for (tag, *w), n in automata.union(trees).prefixes():
            if len(w) == (1 if tag[:1] == b"1" else len(w)) and (tag[:1] == b"1" or len(w) > 1):
                counts[tag[1:].decode(), b" ".join(w).decode()] += n
                assert phrases._ranges_of(tag[1:].decode(), [b" ".join(w)], 11).tolist() == [r]
    want = plain(rows, least=1, longest=4, top=10**9)
    assert {(lang, p): a for lang, _, p, a, *_ in want}.items() <= counts.items()
    assert sum(counts.values()) == sum(max(0, len(p) - k) for t, _ in rows for p in [x.split(" ") if x else [] for x in t.lower().replace(".", "\n").replace("\n ", "\n").split("\n")] for k in range(4))


def test_some_arcs_at_a_time_and_ranges_by_words(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_UNION_ARCS", 40)
    monkeypatch.setattr(phrases, "_RANGE_WORDS", 500)
    asked = []
    monkeypatch.setattr(phrases, "_transducers", lambda *a, of=phrases._transducers: asked.append(a[3]) or of(*a))
    rows = [(t, lang) for lang in ("en", None) for t in texts(300, 7)]
    assert mined(spark, rows, least=4) == plain(rows, least=4)
    assert asked[0] >= sum(len(t.split()) for t, _ in rows) // 500 > 4
