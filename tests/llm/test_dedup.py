import re
from collections import defaultdict

import pytest

from parchment.llm import jaccard
from parchment.llm.exact_dedup import exact_dedup
from parchment.llm.jaccard import jaccard_join, runs_needed
from parchment.llm.line_dedup import line_dedup

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, kept string"


def test_exact_dedup_cases(spark):
    rows = [(1, "a b", "x"), (2, "ab", "x"), (3, "a\tb\n", "x"), (4, None, "x"), (5, "", "x"), (6, " ", "x"), (7, "abc", "x"), (8, "ab", "x"), (None, "abd", "x"), (9, "abc", "x"), (9, "abc", "x")]
    got = exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(3, 4, False)] and by[2] == [(3, 4, False)] and by[3] == [(3, 4, True)] and by[8] == [(3, 4, False)]
    assert by[4] == [(6, 3, False)] and by[6] == [(6, 3, True)]
    assert by[None] == [(None, 1, True)]
    assert by[7] == [(7, 3, True)] and by[9] == [(7, 3, False)] * 2


def test_exact_dedup_empty_and_hot(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "same text" if i % 2 else f"text {i}", "") for i in range(400)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.kept for r in got) == 201 and all(r.keep_id == 1 and r.group_size == 200 for r in got if r.doc_id % 2)


def test_exact_dedup_repeated_row_keeps_one(spark):
    got = exact_dedup(spark.createDataFrame([(1, "a", "")] * 3, DOCS)).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.group_size for r in got} == {3}


def plain_line_dedup(texts, window=3):
    first, cuts = {}, defaultdict(set)
    for d in sorted(texts):
        lines = [(i, x.strip(" \t\r")) for i, x in enumerate((texts[d] or "").split("\n")) if x.strip(" \t\r")]
        for k in range(len(lines) - window + 1):
            key = tuple(x for _, x in lines[k : k + window])
            if key in first:
                cuts[d].update(range(lines[k][0], lines[k + window - 1][0] + 1))
            else:
                first[key] = d
    return {d: t if not cuts[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cuts[d]) for d, t in texts.items()}


def test_line_dedup_cases(spark):
    texts = {1: "a\nb\nc\nd", 2: "x\n a \nb\n\nc\ny", 3: None, 4: "", 5: "a\nb", 6: "b\nc\nd\ne\nz", 7: "q\nq\nq\nq\nq", 8: "\n".join(map(str, range(300)))}
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame([(d, t, "") for d, t in texts.items()], DOCS)).collect()}
    assert {d: r.text for d, r in got.items()} == plain_line_dedup(texts)
    assert got[2].text == "x\ny" and got[6].text == "e\nz" and got[2].n_removed == 4 and [tuple(c) for c in got[2].removed] == [(1, 4)]
    assert got[3].n_lines == 0 and got[3].text is None
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.text for r in line_dedup(spark.createDataFrame([(1, "a\nb\nc", "")] * 2, DOCS)).collect()] == ["a\nb\nc"] * 2


def test_line_dedup_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_line_dedup({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.text for r in line_dedup(docs).collect()} == want


def shingles(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_join(texts, threshold=0.8):
    sets = {d: shingles(t) for d, t in texts.items()}
    holders, links, label = defaultdict(list), defaultdict(int), {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for d in sorted(sets):
        common = defaultdict(int)
        for s in sets[d]:
            for other in holders[s]:
                common[other] += 1
            holders[s].append(d)
        for other, n in common.items():
            if n >= threshold * (len(sets[d]) + len(sets[other]) - n) - 1e-9:
                links[d] += 1
                links[other] += 1
                a, b = root(d), root(other)
                label[max(a, b)] = min(a, b)
    return {d: (root(d), links[d]) for d in texts}


@pytest.mark.parametrize("limits", [{}, {"leaf_sets": 4, "leaf_tokens": 3000, "max_depth": 3}])
def test_jaccard_join_equals_plain(spark, limits):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_join({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs, **limits).collect()}
    assert got == want


def test_jaccard_join_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base.upper()), (3, base + " more"), (4, None), (5, ""), (6, "!!"), (7, "one two"), (8, "One, two"), (9, "two one"), (10, " ".join(f"v{i}" for i in range(50_000))), (11, base)]
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame([(d, t, "") for d, t in rows], DOCS)).collect()}
    assert {d: got[d].class_id for d, _ in rows} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10, 11: 1}
    assert got[1].n_links == 3 and got[3].n_links == 3 and got[1].n_copies == 3 and got[4].n_links == 0
    assert [d for d in got if got[d].kept] == [d for d in got if got[d].class_id == d]
    assert jaccard_join(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_chain_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 120]), "") for k in range(60)]
    got = jaccard_join(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.class_id for r in got} == {0}


def test_runs_needed():
    assert runs_needed(0.8, 0.9999) == 4 and runs_needed(0.8, 0.9) == 1


def test_shingles_are_those_of_plain_python():
    texts = ["A b c d e f", "É é x y z w, v", "a b", "", None, "x" * 3_000_000]
    for ours, t in zip(jaccard.shingle_sets(texts), texts, strict=True):
        assert len(ours) == len(shingles(t))


def test_columns_asked_for(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, None, "z")], "doc_id long, text string, more string")
    whole = {tuple(r) for r in exact_dedup(docs).select("doc_id", "more", "keep_id", "group_size", "kept").collect()}
    few = exact_dedup(docs, columns=["doc_id", "more"])
    assert few.columns == ["doc_id", "more", "keep_id", "group_size", "kept"] and {tuple(r) for r in few.collect()} == whole
