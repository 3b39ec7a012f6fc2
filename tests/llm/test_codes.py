import math
from collections import defaultdict

import numpy as np
import pytest

from parchment.llm import codes

TABLE = "vec_id long, embedding array<float>, label int, code string, `other.name` string"


def plain(vectors, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks in Python's whole numbers."""
    whole = [[math.floor(4096 * x) for x in v] for v in vectors]
    d = len(whole[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for v in whole] for p in range(parts)]
    books = [own[:entries] for own in cut]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x in cut[p]:
                own[nearest(x, books[p])].append(x)
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else entry for e, entry in enumerate(books[p])]
    code = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(whole))]
    return ["".join(f"{e:02x}" for e in c) for c in code], [sum(far(cut[p][i], books[p][c[p]]) for p in range(parts)) for i, c in enumerate(code)], books


def made(n, dim, seed, scale=0.2):
    """Clusters, copies, zeros and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim)) * scale
    out = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * scale / 4
    out[::7] = out[0]
    out[::11] = 0
    out[::13] = np.round(out[::13])
    return out.astype(np.float32).tolist()


@pytest.mark.parametrize(("n", "dim", "scale", "chunk"), [(400, 16, 0.2, 90), (300, 8, 0.01, 2048), (9, 24, 3.0, 4), (60, 16, 1e9, 32), (200, 16, 5e4, 64)])
def test_against_plain(spark, n, dim, scale, chunk):
    vectors = made(n, dim, n, scale)
    rows = [(i, v, None if i % 5 == 0 else i % 3, "x", "y") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    coded, books = codes.compress(df, chunk_rows=chunk)
    got = {r.vec_id: r for r in codes.with_group_error(coded, "label").collect()}
    want, errors, want_books = plain(vectors)
    assert books == want_books and [got[i].code for i in range(n)] == want
    fits = lambda e: e if e < 1 << 63 else None
    assert [got[i].error for i in range(n)] == [fits(e) for e in errors]
    if max(errors) < 1 << 50:
        assert all(got[i].label_error == sum(e for e, r in zip(errors, rows, strict=True) if r[2] == rows[i][2]) for i in range(n))


def test_what_goes_and_what_stays(spark):
    good = [0.25] * 8
    rows = [(1, None, 1), (2, [*good[:7], None], 1), (3, [*good[:7], math.nan], 1), (4, [*good[:7], math.inf], 1), (5, good, None), (5, good, None), (None, [-0.25] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TABLE)
    coded, books = codes.compress(df)
    got = codes.with_group_error(coded, "label").collect()
    assert coded.columns == ["vec_id", "label", "other.name", "code", "error"]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == [("5", "00" * 8, 0, 0)] * 2 + [("None", "02" * 8, 0, 0)]
    assert books == [[[1024], [1024], [-1024]]] * 8
    none, books = codes.compress(df.filter("vec_id < 5"))
    assert none.count() == 0 and books == [] and none.columns == coded.columns and codes.digest(books)
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1, "x", "y")], TABLE))
    with pytest.raises(Exception, match="components"):
        codes.compress(spark.createDataFrame([(k, [1.0] * (8 if k else 16), 1, "x", "y") for k in range(3)], TABLE))[0].collect()


def test_trees_hold_their_points():
    points = codes.scaled(made(700, 8, 3))
    tree = codes.Tree(points)
    assert sorted(tree.order) == list(range(700))
    for low, high, centre, radius, total in zip(tree.low, tree.high, tree.centre, tree.radius, tree.sums, strict=True):
        own = points[tree.order[low:high]]
        assert (own.sum(axis=0) == total).all() and np.sqrt(((own - centre) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12)
    inner = tree.left >= 0
    assert inner.sum() > 10 and (tree.high - tree.low)[~inner].sum() == 700
    # a codebook of far entries: balls are owned without a look at their points
    far = np.array([[0] * 8, [10**6] * 8], np.int64)
    counts, sums, code = tree.assign(points, far, whole=True)
    assert counts.tolist() == [700, 0] and (sums[0] == points.sum(axis=0)).all() and not code.any()
