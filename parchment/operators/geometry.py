"""Work on the boxes, starts and pixels of a page that takes more than a join: sweeps, grids, sliding frames and resampling."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a weight of resampling along one axis.
WEIGHT_BITS = 11
#: Rows of results that are put into one batch: small groups share one.
BATCH_ROWS = 4096
#: Up to so many boxes, pairs are compared one by one, which takes less than the arrays of a sweep.
FEW_BOXES = 24
#: Up to so many pages, each goes by itself, which takes less than steps of arrays.
FEW_PAGES = 8


def group_batches(batches: Iterator[pa.RecordBatch], n: int, work: Callable[[list[tuple]], list[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """by_group() for the batches of a task; the first n columns are the keys. Results of small groups share a batch."""
    here, held, made = None, [], []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)
        made.clear()
        return out

    for got in batches:
        for row in zip(*(c.to_pylist() for c in got.columns), strict=True):
            if row[:n] != here:
                if held:
                    made.extend(work(held))
                    if len(made) >= BATCH_ROWS:
                        yield flush()
                here, held = row[:n], []
            held.append(row)
    if held:
        made.extend(work(held))
    if made:
        yield flush()


def by_group(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], list[tuple]], schema) -> DataFrame:
    """What work makes of the rows of each group, in order. Groups are dealt out and sorted; a task holds one at a time. Null is a key too."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return group_batches(batches, n, work, pa.schema([(f.name, _arrow(f.dataType)) for f in schema]))

    def _arrow(kind) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(kind)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def key_changes(keys: list[pa.Array]) -> np.ndarray:
    """The places of rows, in order, whose keys are not those of the row before. Null is a key too."""
    changed = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for c in keys:
        codes = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        changed |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of sorted batches as batches of whole groups, and where the groups begin in them; the first n columns are the keys.

    What is held is a batch and the group that reaches into it.
    """
    held: list[pa.RecordBatch] = []
    key = lambda batch, at: [c[at].as_py() for c in batch.columns[:n]]

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.concat_batches(parts)
        return whole, np.concatenate([[0], key_changes(whole.columns[:n])])

    for got in batches:
        if not len(got):
            continue
        if held and key(held[-1], -1) != key(got, 0):
            yield joined(held)
            held = []
        last = key_changes(got.columns[:n])[-1:]
        if len(last):
            yield joined([*held, got.slice(0, last[0])])
            held = []
            got = got.slice(last[0])
        held.append(got)
    if held:
        yield joined(held)


def overlapping(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of boxes (x0, y0, x1, y1) whose insides meet, by a sweep along the axis that fewer of them share."""
    best = None
    for axis in (0, 1):
        order = np.argsort(boxes[:, axis], kind="stable")
        upto = np.searchsorted(boxes[order, axis], boxes[order, axis + 2], side="left")
        upto = np.maximum(upto, np.arange(len(order)) + 1)
        cost = int((upto - np.arange(len(order))).sum())
        if best is None or cost < best[0]:
            best = cost, axis, order, upto
    _, axis, order, upto = best
    low, high = boxes[order, 1 - axis], boxes[order, 3 - axis]
    near, far = boxes[order, axis], boxes[order, axis + 2]
    first, second = [], []
    for a in range(len(order)):
        active = slice(a + 1, upto[a])
        met = a + 1 + np.flatnonzero((low[active] < high[a]) & (high[active] > low[a]) & (far[active] > near[a]))
        first.append(np.full(len(met), a))
        second.append(met)
    i, j = order[np.concatenate(first)], order[np.concatenate(second)]
    return np.minimum(i, j), np.maximum(i, j)


def few_overlapping(p: list[list[float]]) -> list[tuple[int, int]]:
    """overlapping() for a few boxes, each pair compared."""
    met = []
    for i, (ax0, ay0, ax1, ay1) in enumerate(p):
        for j in range(i + 1, len(p)):
            bx0, by0, bx1, by1 = p[j]
            if ax0 < bx1 and ax1 > bx0 and ay0 < by1 and ay1 > by0:
                met.append((i, j))
    return met


def part_overlaps(boxes: np.ndarray) -> np.ndarray:
    """part() for an array of boxes."""
    return np.array(part(boxes.tolist())) if len(boxes) > 1 else boxes


def part(p: list[list[float]], turn: int = 0) -> list[list[float]]:
    """Boxes [x0, y0, x1, y1] after the repair of overlaps, with the result of going over all pairs in order again and again.

    Of a pair that overlaps, neither between the other's top and bottom, the upper box's lower edge goes a unit above the middle of the overlap,
    the lower one's upper edge a unit below. Boxes only shrink, so only pairs that overlap at first can do so later, and a pair is
    looked at again only when one of its boxes has moved. The given boxes are changed in place. turn is how often all pairs were gone over before.
    """
    if len(p) < 2:
        return p
    if len(p) <= FEW_BOXES:
        met = few_overlapping(p)
    else:
        first, second = overlapping(np.array(p, np.float64))
        met = sorted(zip(first.tolist(), second.tolist(), strict=True))
    todo, partners = [(turn, i, j) for i, j in met], {}
    for _, i, j in todo:
        partners.setdefault(i, []).append(j)
        partners.setdefault(j, []).append(i)
    waiting, most = set(todo), len(p) ** 2
    while todo:
        at = heapq.heappop(todo)
        waiting.discard(at)
        turn, i, j = at
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = p[i], p[j]
        bottom, top = max(ay0, by0), min(ay1, by1)
        within = (ay0 >= by0 and ay1 <= by1) or (by0 >= ay0 and by1 <= ay1)
        if within or top - bottom <= 1e-6 or min(ax1, bx1) - max(ax0, bx0) <= 1e-6 or turn >= most:
            continue
        low, high = (i, j) if ay1 < by1 else (j, i)
        middle = (bottom + top) / 2
        if not p[high][1] < middle < p[low][3]:
            continue
        p[high][1], p[low][3] = middle + 1, middle - 1
        for box in (i, j):
            for other in partners[box]:
                pair = (box, other) if box < other else (other, box)
                again = (turn if pair > (i, j) else turn + 1, *pair)
                if again not in waiting:
                    waiting.add(again)
                    heapq.heappush(todo, again)
    return p


def part_pages(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """part() for the boxes of many pages, one after another, which begin at starts. The given boxes are changed in place.

    Small pages go together: the first pair of each page, then the second of each, and so on. So a step is one of arrays, and a page takes part
    while its pairs still move. Large pages, and the last few of the small ones, go one by one.
    """
    ends = np.append(starts[1:], len(p))
    sizes = ends - starts
    for a, b in zip(starts[sizes > FEW_BOXES], ends[sizes > FEW_BOXES], strict=True):
        p[a:b] = part(p[a:b].tolist())
    page = np.repeat(np.arange(len(starts)), sizes)
    upto = np.where(sizes > FEW_BOXES, starts, ends)[page]
    firsts, seconds = [], []
    left = np.arange(len(p))
    for apart in range(1, FEW_BOXES):
        left = left[left + apart < upto[left]]
        a, b = p[left], p[left + apart]
        met = (a[:, 0] < b[:, 2]) & (a[:, 2] > b[:, 0]) & (a[:, 1] < b[:, 3]) & (a[:, 3] > b[:, 1])
        firsts.append(left[met])
        seconds.append(left[met] + apart)
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    x0, y0, x1, y1 = (p[:, c] for c in range(4))
    with np.errstate(invalid="ignore"):
        beside = np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j]) > 1e-6
    i, j = i[beside], j[beside]
    of = page[i]
    turn = 0
    while len(i):
        begun = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        if len(begun) <= FEW_PAGES:
            for at in of[begun]:
                a, b = starts[at], ends[at]
                p[a:b] = part(p[a:b].tolist(), turn)
            break
        place = np.arange(len(i)) - np.repeat(begun, np.diff(np.append(begun, len(i))))
        moved = np.zeros(len(starts), bool)
        step = np.argsort(place, kind="stable")
        for at in np.split(step, np.cumsum(np.bincount(place))[:-1]):
            a, b = i[at], j[at]
            ay0, ay1, by0, by1 = y0[a], y1[a], y0[b], y1[b]
            bottom, top = np.maximum(ay0, by0), np.minimum(ay1, by1)
            with np.errstate(invalid="ignore"):
                middle, height = (bottom + top) / 2, top - bottom
            under = ay1 < by1
            low, high = np.where(under, a, b), np.where(under, b, a)
            within = ((ay0 >= by0) & (ay1 <= by1)) | ((by0 >= ay0) & (by1 <= ay1))
            hit = ~within & (height > 1e-6) & (np.where(under, by0, ay0) < middle) & (middle < np.where(under, ay1, by1))
            y0[high[hit]], y1[low[hit]] = middle[hit] + 1, middle[hit] - 1
            moved[of[at[hit]]] = True
        turn += 1
        again = (moved & (turn < sizes**2))[of]
        i, j, of = i[again], j[again], of[again]
    return p


def separate_overlaps(boxes: DataFrame, page: str, box: str, stream: str | None = None) -> DataFrame:
    """Boxes of which overlapping ones of a page (and stream, if it is given) are parted: see part_overlaps.

    Boxes go in order of box. A null stream is a stream too. A task holds a batch of boxes and one page, or one stream of it, at a time; coordinates
    are arrays of numbers there, all else stays as Arrow has it.
    """
    keys, sides = [page, *([stream] if stream else [])], ("x0", "y0", "x1", "y1")
    rows = boxes.select(*keys, box, *[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c) for c in sides])
    n = len(keys)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, starts in whole_groups(batches, n):
            p = part_pages(np.stack([got.column(c).to_numpy(zero_copy_only=False) for c in sides], axis=1), starts)
            yield pa.RecordBatch.from_arrays([*got.columns[:-4], *(pa.array(p[:, c]) for c in range(4))], got.schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, box).mapInArrow(parted, rows.schema)


def match_starts(starts: list[tuple], operators: list[tuple], near: float) -> list[tuple]:
    """For starts and operators (seq, x, y), in order: pairs (seq, operator's seq), each start with the next operator within near.

    Operators lie in a grid of cells of half the distance, each with its operators in order. A start asks the cells around it for the first
    one after the last match, and what is passed over is never looked at again.
    """
    size, grid = near / 2, {}
    cell = lambda v: math.floor(v / size)
    for at, (_, x, y) in enumerate(operators):
        if math.isfinite(x) and math.isfinite(y):
            grid.setdefault((cell(x), cell(y)), []).append(at)
    passed: dict[tuple[int, int], int] = {}
    out, cursor = [], 0
    for seq, x, y in starts:
        if not (math.isfinite(x) and math.isfinite(y)):
            continue
        cx, cy, best = cell(x), cell(y), None
        for key in ((cx + dx, cy + dy) for dx in range(-3, 4) for dy in range(-3, 4)):
            own = grid.get(key)
            if own is None:
                continue
            at = passed[key] = bisect_left(own, cursor, passed.get(key, 0))
            while at < len(own) and (best is None or own[at] < best):
                _, ox, oy = operators[own[at]]
                if (ox - x) ** 2 + (oy - y) ** 2 <= near**2:
                    best = own[at]
                    break
                at += 1
        if best is not None:
            out.append((seq, operators[best][0]))
            cursor = best + 1
    return out


def match_in_order(firsts: DataFrame, operators: DataFrame, keys: list[str], near: float) -> DataFrame:
    """Each glyph start with the next operator of its keys (page and path of forms) that is near it: keys, seq, op_seq.

    Starts go in order of seq, and an operator passed over is not looked at again once a later one is matched. Null coordinates
    match nothing. A task holds the starts and operators of one page and path.
    """
    side = lambda df, k: df.select(*keys, F.lit(k).alias("side"), "seq", F.coalesce(F.col("x").cast("double"), F.lit(math.nan)).alias("x"), F.coalesce(F.col("y").cast("double"), F.lit(math.nan)).alias("y"))
    both = side(firsts, 1).unionByName(side(operators, 0))
    schema = both.select(*keys, "seq", F.col("seq").alias("op_seq")).schema

    def work(held: list[tuple]) -> list[tuple]:
        sides = [[h[-3:] for h in held if h[-4] == k] for k in (0, 1)]
        return [(*held[0][: len(keys)], a, b) for a, b in match_starts(sides[1], sides[0], near)]

    return by_group(both, keys, ["side", "seq"], work, schema)


def similarity(pixels: DataFrame, key: str, window: int = 7) -> DataFrame:
    """Structural similarity of pairs of gray images, given as pixels (key, x, y, a, b: whole numbers from 0 to 255): key, similarity.

    Windows of 7 x 7 are summed by frames that slide along the rows and then down the columns, so no task holds an image. Sums
    are whole numbers. The variances are those of samples; windows that reach over the edge don't count. An image of fewer rows or columns
    has no window and no row in the result.
    """
    n = window * window
    sums = {"a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")}
    summed = pixels.select(key, "x", "y", *[v.cast("long").alias(k) for k, v in sums.items()])
    for along, across in (("x", "y"), ("y", "x")):
        frame = Window.partitionBy(key, across).orderBy(along).rowsBetween(1 - window, 0)
        summed = summed.select(key, "x", "y", *[F.sum(k).over(frame).alias(k) for k in sums], F.count("*").over(frame).alias("held")).filter(F.col("held") == window).drop("held")
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = F.col("a") / n, F.col("b") / n
    va, vb, vab = ((n * F.col(s) - F.col(p) * F.col(q)) / (n * (n - 1)) for s, p, q in (("aa", "a", "a"), ("bb", "b", "b"), ("ab", "a", "b")))
    value = ((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return summed.groupBy(key).agg(F.avg(value).alias("similarity"))


def axis_weights(source: Column, target: Column, at: Column) -> Column:
    """For place at of target places along an axis of source pixels: from, the first pixel, and w, its weight of 2048; the next one has the rest.

    Centres lie in the middle of pixels; before the first and after the last centre the pixel itself is taken.
    """
    place = (at + 0.5) * (source.cast("double") / target) - 0.5
    first = F.floor(place)
    inside = (first >= 0) & (first < source - 1)
    whole = F.lit(1 << WEIGHT_BITS)
    weight = F.floor((1 - (place - first)) * whole + 0.5)
    return F.struct(F.least(F.greatest(first, F.lit(0)), source - 1).cast("int").alias("from"), F.when(inside, weight).otherwise(whole).cast("long").alias("w"))


def resize(rows: DataFrame, key: str, width: str, height: str, to_width: Column, to_height: Column, channels: int = 3) -> DataFrame:
    """Images resampled along one axis and then the other, in whole numbers: key, y and pixels, an array for each row.

    rows has a row of pixels (an array of numbers from 0 to 255, the channels of a pixel one after another) for each key and y, and the image's
    width and height. Rows are resampled where they are. Each row that results asks for the two that it lies between, so
    rows meet by key and y, and no task holds an image. Images of no pixels or of no size give nothing.
    """
    shift = 2 * WEIGHT_BITS
    sized = rows.filter((F.col(width) > 0) & (F.col(height) > 0) & (to_width > 0) & (to_height > 0)).select(key, "y", "pixels", F.col(width).alias("w0"), F.col(height).alias("h0"), to_width.cast("int").alias("w1"), to_height.cast("int").alias("h1"))
    value = lambda x, c: F.get("pixels", x * channels + c).cast("long")
    one = lambda x: F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: value(x["from"], c) * x["w"] + F.coalesce(value(F.least(x["from"] + 1, F.col("w0") - 1), c), F.lit(0)) * ((1 << WEIGHT_BITS) - x["w"]))
    across = F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.col("w1") - 1), lambda x: axis_weights(F.col("w0"), F.col("w1"), x)), one))
    lines = sized.select(key, "y", "h0", "h1", across.alias("line"))
    # a source row serves the target rows whose two source rows it is one of
    asked = sized.filter("y = 0").select(key, "h0", "h1", F.explode(F.sequence(F.lit(0), F.col("h1") - 1)).alias("to")).withColumn("a", axis_weights(F.col("h0"), F.col("h1"), F.col("to")))
    asked = asked.select(key, "to", F.explode(F.array(F.struct(F.col("a.from").alias("y"), F.col("a.w").alias("w"), F.lit(0).alias("part")), F.struct(F.least(F.col("a.from") + 1, F.col("h0") - 1).alias("y"), ((1 << WEIGHT_BITS) - F.col("a.w")).alias("w"), F.lit(1).alias("part")))).alias("s")).select(key, "to", "s.*")
    met = asked.join(lines.select(key, "y", "line"), [key, "y"]).groupBy(key, "to").agg(F.min_by(F.struct("line", "w"), "part").alias("u"), F.max_by(F.struct("line", "w"), "part").alias("v"))
    mixed = F.zip_with("u.line", "v.line", lambda a, b: F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(a * F.col("u.w") + b * F.col("v.w") + (1 << (shift - 1)), shift))).cast("int"))
    return met.select(key, F.col("to").alias("y"), mixed.alias("pixels"))
