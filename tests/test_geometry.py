"""Sweeps, grids, frames and resampling against plain loops, at size; planned batches on the given cases."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.functions import predicates
from parchment.operators import batching, geometry, layout


def plain_parts(boxes):
    p = [list(b) for b in boxes]
    for _ in range(len(p) ** 2):
        found = False
        for i in range(len(p)):
            for j in range(i + 1, len(p)):
                a, b = p[i], p[j]
                if not (a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]):
                    continue
                if (a[1] >= b[1] and a[3] <= b[3]) or (b[1] >= a[1] and b[3] <= a[3]):
                    continue
                bottom, top = max(a[1], b[1]), min(a[3], b[3])
                if top - bottom > 1e-6 and min(a[2], b[2]) - max(a[0], b[0]) > 1e-6:
                    found = True
                    lower, higher = (a, b) if (a[3] > b[1] and a[1] < b[1]) or a[3] < b[3] else (b, a)
                    middle = bottom + (top - bottom) / 2
                    if higher[1] < middle < lower[3]:
                        higher[1], lower[3] = middle + 1, middle - 1
        if not found:
            break
    return p


def some_boxes(r, n, side, most):
    return [[x, y, x + r.randint(1, most), y + r.randint(1, most)] for x, y in ((r.randint(0, side), r.randint(0, side)) for _ in range(n))]


def test_overlaps_as_the_plain_loop_parts_them():
    r = random.Random(1)
    for n in (1, 2, 3, 8, 20, 40):
        for _ in range(12):
            boxes = some_boxes(r, n, 30, 18)
            assert np.allclose(geometry.part_overlaps(np.array(boxes, float)), plain_parts(boxes))
    flat = [[0, 0, 10, 0], [0, 0, 10, 10], [5, 5, 5, 20]]
    assert np.allclose(geometry.part_overlaps(np.array(flat, float)), plain_parts(flat))


def test_many_boxes_on_a_page():
    r = random.Random(2)
    began = time.time()
    out = geometry.part_overlaps(np.array(some_boxes(r, 20_000, 3000, 40), float))
    assert time.time() - began < 30 and len(out) == 20_000
    first, second = geometry.overlapping(out)
    a, b = out[first], out[second]
    within = ((a[:, 1] >= b[:, 1]) & (a[:, 3] <= b[:, 3])) | ((b[:, 1] >= a[:, 1]) & (b[:, 3] <= a[:, 3]))
    assert within.all()


def test_streams_are_parted_each_by_itself(spark):
    r = random.Random(3)
    rows = [(k % 3, None if k % 4 == 0 else f"s{k % 4}", k, *map(float, b)) for k, b in enumerate(some_boxes(r, 60, 30, 18))]
    df = spark.createDataFrame(rows, "page int, stream string, b int, x0 double, y0 double, x1 double, y1 double")
    got = {x.b: (x.x0, x.y0, x.x1, x.y1) for x in geometry.separate_overlaps(df, "page", "b", "stream").collect()}
    for page in range(3):
        for s in {x[1] for x in rows}:
            own = [x for x in rows if x[:2] == (page, s)]
            for x, want in zip(own, plain_parts([x[3:] for x in own]), strict=True):
                assert got[x[2]] == pytest.approx(tuple(want))
    assert geometry.separate_overlaps(df.limit(0), "page", "b").count() == 0


def plain_matches(starts, operators, near):
    out, cursor = [], 0
    for seq, x, y in starts:
        for i in range(cursor, len(operators)):
            if math.hypot(operators[i][1] - x, operators[i][2] - y) <= near:
                out.append((seq, operators[i][0]))
                cursor = i + 1
                break
    return out


def test_starts_as_the_plain_loop_matches_them():
    r = random.Random(5)
    for side in (2, 5, 30):
        for _ in range(20):
            operators = [(k, r.uniform(-side, side), r.choice([0.0, 1.0, 2.5])) for k in range(60)]
            starts = [(k, x + r.uniform(-1.2, 1.2), y) for k, x, y in operators if r.random() < 0.8]
            assert geometry.match_starts(starts, operators, 1.0) == plain_matches(starts, operators, 1.0)
    n = 100_000
    operators = [(k, float(r.randint(0, 600)), float(r.randint(0, 800))) for k in range(n)]
    began = time.time()
    assert len(geometry.match_starts(operators[::2], operators, 1.0)) > n / 100
    same = [(k, 5.0, 5.0) for k in range(n)]
    assert geometry.match_starts(same, same, 1.0) == [(k, k) for k in range(n)]
    assert time.time() - began < 30


def test_starts_match_operators_of_their_path_alone(spark):
    op = [(1, "", 0, 1.0, 1.0), (1, "1", 1, 1.0, 1.0), (1, None, 2, 1.0, 1.0), (2, "", 3, None, 1.0)]
    at = [(1, "1", 0, 1.5, 1.0), (1, None, 1, 1.0, 1.0), (1, "2", 2, 1.0, 1.0), (2, "", 3, 1.0, 1.0)]
    schema = "page int, path string, seq int, x double, y double"
    got = geometry.match_in_order(spark.createDataFrame(at, schema), spark.createDataFrame(op, schema), ["page", "path"], 1.0).collect()
    assert sorted((x.seq, x.op_seq) for x in got) == [(0, 1), (1, 2)]


def test_lifts_read_the_boxes_as_they_were(spark):
    """The boxes go one after another, but a lift changes a lower edge only, which no other box looks at: so order doesn't matter."""
    r = random.Random(6)
    for trial in range(4):
        boxes = {k: list(map(float, b)) for k, b in enumerate(some_boxes(r, 25, 40, 45))}
        was, now = {k: list(b) for k, b in boxes.items()}, {k: list(b) for k, b in boxes.items()}
        for k in sorted(boxes, reverse=trial % 2 == 1):
            x0, y0, x1, y1 = now[k]
            gap = 0.5 if y1 - y0 < 36 else 3
            hit = [o for o, b in was.items() if o != k and b[0] <= x1 and b[2] >= x0 and b[1] <= y0 and b[3] >= y0 - gap]
            hit = [o for o in hit if not (now[o][2] < x0 or now[o][0] > x1)]
            if hit and (top := max(now[o][3] for o in hit) + gap) < y1:
                now[k][1] = top
        df = spark.createDataFrame([(1, k, *b) for k, b in boxes.items()], "page int, b int, x0 double, y0 double, x1 double, y1 double")
        assert {x.b: x.lifted for x in layout.touching_below(df, ["page"], "b").collect()} == {k: b[1] for k, b in now.items()}


def test_similarity_of_pixels(spark):
    r = np.random.default_rng(4)
    images = {k: (r.integers(0, 256, shape, np.uint8), r.integers(0, 256, shape, np.uint8)) for k, shape in enumerate([(7, 7), (9, 30), (40, 8)])}
    images[3] = (images[1][0], images[1][0])
    images[4] = (np.zeros((6, 50), np.uint8), np.zeros((6, 50), np.uint8))
    pixels = [(k, x, y, int(a[y, x]), int(b[y, x])) for k, (a, b) in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    got = {x.key: x.similarity for x in geometry.similarity(spark.createDataFrame(pixels, "key int, x int, y int, a int, b int"), "key").collect()}
    assert set(got) == {0, 1, 2, 3} and got[3] == pytest.approx(1)
    assert all(got[k] == pytest.approx(layout.ssim(*images[k])) for k in got)


def plain_resize(image, w1, h1):
    """Separable, with weights of 11 bits, in Python's whole numbers."""
    h0, w0, channels = image.shape

    def axis(n, to):
        out = []
        for d in range(to):
            place = (d + 0.5) * (n / to) - 0.5
            first, rest = math.floor(place), place - math.floor(place)
            if first < 0 or first >= n - 1:
                first, rest = (0 if first < 0 else n - 1), 0
            out.append((first, min(first + 1, n - 1), math.floor((1 - rest) * 2048 + 0.5)))
        return out

    out = np.zeros((h1, w1, channels), int)
    for y, (a, b, wy) in enumerate(axis(h0, h1)):
        for x, (c, d, wx) in enumerate(axis(w0, w1)):
            for k in range(channels):
                line = [int(image[row, c, k]) * wx + int(image[row, d, k]) * (2048 - wx) for row in (a, b)]
                out[y, x, k] = min(255, max(0, (line[0] * wy + line[1] * (2048 - wy) + (1 << 21)) >> 22))
    return out


def test_resizing(spark):
    r = np.random.default_rng(8)
    cases = [((4, 6, 3), 9, 7), ((1, 1, 3), 3, 2), ((5, 5, 3), 5, 5), ((8, 3, 3), 1, 1), ((2, 9, 3), 18, 4)]
    images = {k: r.integers(0, 256, shape, np.uint8) for k, (shape, _, _) in enumerate(cases)}
    rows = [(k, y, [int(v) for v in image[y].ravel()], image.shape[1], image.shape[0], *cases[k][1:]) for k, image in images.items() for y in range(image.shape[0])]
    rows.append((9, 0, [], 0, 1, 3, 3))
    df = spark.createDataFrame(rows, "key int, y int, pixels array<int>, w int, h int, w1 int, h1 int")
    got = {(x.key, x.y): x.pixels for x in geometry.resize(df, "key", "w", "h", F.col("w1"), F.col("h1")).collect()}
    for k, (_, w1, h1) in enumerate(cases):
        want = plain_resize(images[k], w1, h1)
        assert [got[k, y] for y in range(h1)] == [list(map(int, line.ravel())) for line in want]
    assert len(got) == sum(h1 for _, _, h1 in cases)
    assert (plain_resize(images[2], 5, 5) == images[2]).all()


def planned(spark, rows):
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, page int, ord int, label string, top double, text string")
    return [(r.kind, [tuple(i) for i in r["items"]], r.title, r.local_title) for r in batching.plan_batches(df, ["doc"], "page", "ord").orderBy("seq").collect()]


def test_planned_batches(spark):
    body = "plain text"
    assert [len(i) for _, i, _, _ in planned(spark, [(1, k, "x", 0.0, "some words here") for k in range(7)])] == [6, 1]
    assert planned(spark, [(1, 0, "x", 0.0, "abc"), (1, 1, "x", 0.0, "12345"), (1, 2, "x", 0.0, "normal text"), (1, 3, None, 0.0, None)]) == [("page", [(1, 2)], None, None)]
    # the last of a page with the first of the next; what is left is packed by page
    got = planned(spark, [(p, k, body, 0.0, f"body text {p} {k}") for p in (1, 2) for k in (0, 1)])
    assert [x[:2] for x in got] == [("pages", [(1, 1), (2, 0)]), ("page", [(1, 0)]), ("page", [(2, 1)])]
    # a jump of over 20 between columns; a paragraph that a pair has used is in no other
    got = planned(spark, [(1, k, body, t, f"body text {k}") for k, t in enumerate([0.0, 30.0, 60.0, 61.0, 90.0])])
    assert [x[:2] for x in got] == [("columns", [(1, 0), (1, 1)]), ("columns", [(1, 3), (1, 4)]), ("page", [(1, 2)])]
    # the column pass starts from what the page pass has left
    got = planned(spark, [(1, 0, body, 0.0, "body text a"), (1, 1, body, 30.0, "body text b"), (2, 0, body, 0.0, "body text c"), (2, 1, body, 30.0, "body text d"), (2, 2, body, 60.0, "body text e")])
    assert [x[:2] for x in got] == [("pages", [(1, 1), (2, 0)]), ("columns", [(2, 1), (2, 2)]), ("page", [(1, 0)])]
    # the first title, and the last one that packing had met when the batch was closed
    rows = [(1, 0, "title", 0.0, "First title"), *[(1, k, "x", 0.0, f"words of text {k}") for k in range(1, 7)], (2, 0, "title", 0.0, "Second title"), (2, 1, "x", 0.0, "more words")]
    assert [(len(i), t, lt) for _, i, t, lt in planned(spark, rows)] == [(6, "First title", "First title"), (1, "First title", "First title"), (2, "First title", "Second title")]
    # a single paragraph of running text is paired once, and pages without any are in between
    got = planned(spark, [(1, 0, body, 0.0, "body text"), (2, 0, body, 0.0, "body text"), (3, 0, body, 0.0, "body text"), (4, 0, "x", 0.0, "a caption"), (5, 0, body, 0.0, "body text")])
    assert [x[:2] for x in got] == [("pages", [(1, 0), (2, 0)]), ("page", [(3, 0)]), ("page", [(4, 0)]), ("page", [(5, 0)])]


def test_kinds_of_errors(spark):
    cases = [
        (401, "", "credential"), (402, "rate limit", "credential"), (403, "rate limit reached", "rateLimited"), (403, "no", "fatal"), (404, "x", "fatal"), (408, "", "transient"), (500, "invalid api key", "transient"), (525, "", "transient"), (529, "", "transient"),
        (530, "", "transient"), (429, "slow down", "rateLimited"), (429, "insufficient funds", "credential"), (429, "You exceeded your current quota", "credential"), (413, "", "oversized"), (400, "no", "rejected"), (422, "no", "rejected"), (418, "", "rejected"),
        (200, "no", "transient"), (600, "", "transient"), (None, "x", "transient"), (400, None, "rejected"), (403, None, "fatal"), (429, None, "rateLimited"),
    ]
    df = spark.createDataFrame([(s, b) for s, b, _ in cases], "s int, b string")
    got = df.select("s", "b", predicates.classify_http(F.col("s"), F.col("b")).alias("k"), predicates.classify_http(F.col("s").cast("double"), F.col("b")).alias("k2")).collect()
    assert [(r.s, r.b, r.k) for r in got] == cases and all(r.k == r.k2 for r in got)
