import re
from collections import Counter, defaultdict

import pytest

from parchment.llm import automata, phrases, queries

SF = "/root/testdata/sf0.001"
TABLE = "text string, lang string, a string, rank string"
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=30, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, count in f.items():
        cand = {w: a for w, a in count.items() if len(w) > 1 and a >= least}
        gone = {w[i : i + k] for w, a in cand.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 80 * cand[w[i : i + k]]}
        scored = []
        for w, a in cand.items():
            if w not in gone:
                score, _, left, right = min((2000000 * a // (count[w[:k]] + count[w[k:]]), k, count[w[:k]], count[w[k:]]) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mined(spark, rows, **how):
    return sorted(tuple(r) for r in phrases.mine(spark.createDataFrame([(t, lang, "x", "y") for t, lang in rows], TABLE), **how).collect())


def test_query_against_plain(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_phrases(spark, SF).collect()) == plain(rows)


@pytest.mark.parametrize(("least", "top", "longest"), [(2, 2000, 4), (3, 5, 3), (5, 2000, 2)])
def test_odd_texts(spark, monkeypatch, least, top, longest):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 40)
    rows = [("The big Cat\tsat. the big cat!the  big cat ran\nthe big", "en"), ("the big cat sat", None), (None, "en"), ("", None), (" . , ", "fr"), ("ÄB äb Äb äb äb é", "und"), ("x\rx\x0bx\x0cx x\x85x x x", "en"), ("a b " * 30, "en"), ("\x00 \x00 a \x00 \x00", "fr"), ("x" * 100_000 + " y", "fr")]
    rows += rows[:4] + [("a b c d e", "en")] * 5
    got = mined(spark, rows, least=least, top=top, longest=longest)
    assert got == plain(rows, least, longest, top) and got


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("a b", "en")]) == []


def test_hot_pair_and_ties(spark):
    rows = [(f"hot pair w{k} v{k % 7} hot pair", "en") for k in range(200)] + [("p q", "de"), ("r s", "de")] * 30
    assert mined(spark, rows) == plain(rows)


def sequences(words, n, seed):
    import random

    r = random.Random(seed)
    return sorted((tuple(r.choice(words) for _ in range(r.randint(1, 4))), r.randint(1, 5)) for _ in range(n))


def prefix_counts(held):
    c = Counter()
    for w, n in held:
        for k in range(1, len(w) + 1):
            c[w[:k]] += n
    return c


def test_automata():
    some, more = sequences([b"a", b"b", b"c"], 300, 1), sequences([b"b", b"c", b"dd"], 200, 2)
    one, other = automata.build(some), automata.Transducer.unpacked(automata.build(more).packed())
    assert dict(one.prefixes()) == prefix_counts(some) and [w for w, _ in one.prefixes()] == sorted(prefix_counts(some))
    both = automata.union([one, other])
    assert dict(both.prefixes()) == prefix_counts(some + more) and automata.build(sorted(some + more)).states[both.root] is not None
    least = automata.union([one, other, automata.build([])], 40)
    assert dict(least.prefixes()) == {w: n for w, n in prefix_counts(some + more).items() if n >= 40}
    asked = sorted({w for w, _ in sequences([b"a", b"b", b"dd", b"zz"], 50, 3)})
    found = dict(automata.compose(automata.build(((*w, automata.END), 1) for w in asked), both))
    assert found == {w: prefix_counts(some + more)[w] for w in asked if w in prefix_counts(some + more)}
    # suffixes are shared: many first words with one continuation are two states besides the root
    assert len(automata.build(((b"%03d" % k, b"x", b"y"), 1) for k in range(100)).states) == 4
