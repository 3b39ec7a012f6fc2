"""Boxes on pages: classes of characters, coverage, neighbours, overlaps and votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.operators.geometry import separate_overlaps as separate_overlaps

#: Names of boxes whose inside is kept as it is.
PRESERVED = ("abandon", "figure", "table", "isolate_formula", "formula_caption")
GRID = 64


def box_classes(chars: DataFrame, boxes: DataFrame, page: list[str], char: str = "char_id") -> DataFrame:
    """cls for each character (x, y from the bottom): 0 in a kept box, i + 2 in text box i, else 1.

    Boxes (box_idx by falling confidence, name, x0, y0, x1, y1 from the top, page_w, page_h) widen by a pixel, are
    cut to whole pixels and to the page. Kept boxes win, then the text box of least confidence. Characters meet only
    the boxes of their page: the join is by page, with the position as a condition on top.
    """
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0)), most - 1)
    cell = lambda v, most: clip(v.cast("long"), most)
    w, h = F.col("page_w"), F.col("page_h")
    kept = F.col("name").isin(*PRESERVED)
    painted = boxes.select(
        *page, F.when(kept, 1_000_000).otherwise(F.col("box_idx")).alias("__rank"), F.when(kept, 0).otherwise(F.col("box_idx") + 2).alias("__cls"),
        cell(F.col("x0") - 1, w).alias("__l"), cell(h - F.col("y1") - 1, h).alias("__b"), cell(F.col("x1") + 1, w).alias("__r"), cell(h - F.col("y0") + 1, h).alias("__t"),
    )
    cells = chars.withColumns({"__x": cell(F.col("x"), w), "__y": cell(F.col("y"), h)})
    on = [cells[p] == painted[p] for p in page] + [cells["__x"] >= painted["__l"], cells["__x"] < painted["__r"], cells["__y"] >= painted["__b"], cells["__y"] < painted["__t"]]
    met = cells.join(painted, on, "left").select(*[cells[c] for c in [*page, char]], "__rank", "__cls")
    return met.groupBy(*page, char).agg(F.coalesce(F.max_by("__cls", "__rank"), F.lit(1)).cast("long").alias("cls"))


def coverage(boxes: DataFrame, page: list[str], grid: int = GRID) -> DataFrame:
    """The share of a page's grid cells, of at most 64 x 64, whose centre lies in a box.

    A box becomes one number of its first and last cells, and a page the set of its numbers, of which there are at most 4.4 million whatever its boxes.
    A box tells for each of its rows which cells of it are in, as the bits of a number; those are or-ed row by row.
    """
    if not 0 < grid <= 64:
        raise ValueError("a grid has 1 to 64 rows")
    cw, ch = F.col("page_w") / grid, F.col("page_h") / grid
    first = lambda lo, size: F.greatest(F.lit(0), F.ceil(lo / size - 0.5)).cast("int")
    last = lambda hi, size: F.least(F.lit(grid - 1), F.floor(hi / size - 0.5)).cast("int")
    x0, x1, y0, y1 = first(F.col("x0"), cw), last(F.col("x1"), cw), first(F.col("y0"), ch), last(F.col("y1"), ch)
    packed = F.when((x0 <= x1) & (y0 <= y1), x0 + x1 * 64 + y0 * 4096 + y1 * 262_144)
    pages = boxes.select(*page, packed.alias("box")).groupBy(*page).agg(F.collect_set("box").alias("boxes"))
    part = lambda v, at: F.shiftright(v, at).bitwiseAND(F.lit(63))
    bits = lambda v: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - (part(v, 6) - part(v, 0))), part(v, 0))
    spans = F.transform("boxes", lambda v: F.struct(part(v, 12).alias("first"), part(v, 18).alias("last"), bits(v).alias("bits")))
    pages = pages.select(*page, spans.alias("spans"))
    inside = lambda row: F.aggregate("spans", F.lit(0).cast("long"), lambda o, s: F.when(row.between(s["first"], s["last"]), o.bitwiseOR(s["bits"])).otherwise(o))
    rows = F.when(F.size("spans") > 0, F.sequence(F.array_min("spans.first"), F.array_max("spans.last")))
    cells = F.aggregate(rows, F.lit(0), lambda n, row: n + F.bit_count(inside(row)))
    return pages.select(*page, (F.coalesce(cells, F.lit(0)) / (grid * grid)).alias("coverage"))


def nearest_right(boxes: DataFrame, page: list[str], box: str, edge: str = "page_w") -> DataFrame:
    """max_x for each box: where the nearest box to its right begins among those beside it, or the page's edge."""
    a, b = boxes.alias("a"), boxes.alias("b")
    same = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page]
    beside = (F.col("b.x0") > F.col("a.x0")) & ~((F.col("b.y0") >= F.col("a.y1")) | (F.col("b.y1") <= F.col("a.y0")))
    met = a.join(b, [*same, beside], "left")
    return met.groupBy(*[F.col(f"a.{c}") for c in [*page, box]]).agg(F.min(F.least(F.col(f"a.{edge}"), F.coalesce("b.x0", F.col(f"a.{edge}")))).alias("max_x"))


def nearest_below(boxes: DataFrame, page: list[str], box: str, edge: float | Column = 0.0) -> DataFrame:
    """min_y for each box: where the nearest box below it (y grows upwards) ends among those above or under it, or the page's edge."""
    a, b = boxes.withColumn("__edge", edge if isinstance(edge, Column) else F.lit(edge)).alias("a"), boxes.alias("b")
    same = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page]
    under = (F.col("b.y1") < F.col("a.y0")) & ~((F.col("b.x0") >= F.col("a.x1")) | (F.col("b.x1") <= F.col("a.x0")))
    met = a.join(b, [*same, under], "left")
    return met.groupBy(*[F.col(f"a.{c}") for c in [*page, box]]).agg(F.max(F.greatest("a.__edge", F.coalesce("b.y1", "a.__edge"))).alias("min_y"))


def overlapping_pairs(boxes: DataFrame, page: list[str], box: str) -> DataFrame:
    """Pairs of boxes of a page that overlap, neither between the other's top and bottom: first, second, height, width."""
    a, b = boxes.alias("a"), boxes.alias("b")
    same = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page]
    over = (F.col("a.x0") < F.col("b.x1")) & (F.col("a.x1") > F.col("b.x0")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("a.y1") > F.col("b.y0"))
    inside = ((F.col("a.y0") >= F.col("b.y0")) & (F.col("a.y1") <= F.col("b.y1"))) | ((F.col("b.y0") >= F.col("a.y0")) & (F.col("b.y1") <= F.col("a.y1")))
    met = a.join(b, [*same, F.col(f"a.{box}") < F.col(f"b.{box}"), over, ~inside])
    return met.select(
        *[F.col(f"a.{p}") for p in page], F.col(f"a.{box}").alias("first"), F.col(f"b.{box}").alias("second"),
        (F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")).alias("height"), (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")).alias("width"),
    )


def touching_below(boxes: DataFrame, page: list[str], box: str) -> DataFrame:
    """lifted: where a box's lower edge goes to clear the boxes just below, which lie within 0.5, or 3 for tall ones."""
    a, b = boxes.withColumn("gap", F.when(F.col("y1") - F.col("y0") < 36, 0.5).otherwise(3.0)).alias("a"), boxes.alias("b")
    same = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page]
    below = (F.col(f"a.{box}") != F.col(f"b.{box}")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("b.x1") >= F.col("a.x0")) & (F.col("b.y0") <= F.col("a.y0")) & (F.col("b.y1") >= F.col("a.y0") - F.col("a.gap"))
    met = a.join(b, [*same, below], "left").groupBy(*[F.col(f"a.{c}") for c in [*page, box, "y0", "y1", "gap"]]).agg(F.max("b.y1").alias("__top"))
    moved = F.col("__top") + F.col("gap")
    return met.select(*page, box, F.when(moved < F.col("y1"), moved).otherwise(F.col("y0")).alias("lifted"))


def detected(boxes: DataFrame, page: list[str], order: str, least: float = 0.25) -> DataFrame:
    """Boxes (conf) that a detector is sure enough of, with box_idx by falling confidence; equally sure ones keep their order. Null is not sure."""
    w = Window.partitionBy(*page).orderBy(F.desc("conf"), order)
    return boxes.filter(F.col("conf") > least).withColumn("box_idx", F.row_number().over(w).cast("long") - 1)


def scale_cap(scales: DataFrame, by: list[str], scale: str, weight: str) -> DataFrame:
    """capped: each scale at most the one of greatest weight in its group, the least of equally heavy ones."""
    sums = scales.groupBy(*by, scale).agg(F.sum(weight).alias("__w"))
    caps = sums.groupBy(*by).agg(F.max_by(scale, F.struct(F.col("__w"), -F.col(scale))).alias("cap"))
    return scales.join(caps, by).withColumn("capped", F.least(scale, "cap"))


def second_gap(gaps: Column) -> Column:
    """The second smallest distinct gap over 1; the only one if there is one, else 1."""
    distinct = F.array_sort(F.array_distinct(F.filter(gaps, lambda g: g > 1)))
    return F.when(F.size(distinct) == 0, 1.0).when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise(F.get(distinct, F.lit(1)))


def scan_vote(pages: DataFrame, by: list[str], order: str, scanned: Column) -> DataFrame:
    """Whether a document is scanned, by the votes of its pages in order, which end when they can't change the result.

    Scanned are documents with max(0.8 n, 1) scanned pages read. Reading stops at that number, or when n less that
    number were not scanned; pages not read count as not scanned.
    """
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    votes = pages.withColumns({"__yes": scanned.cast("int"), "__n": F.count("*").over(whole)})
    votes = votes.withColumns({"__y": F.coalesce(F.sum("__yes").over(before), F.lit(0)), "__no": F.coalesce(F.sum(1 - F.col("__yes")).over(before), F.lit(0)), "__t": F.greatest(F.col("__n") * 0.8, F.lit(1.0))})
    votes = votes.withColumn("__read", (F.col("__y") < F.col("__t")) & (F.col("__no") < F.col("__n") - F.col("__t")))
    yes = F.sum(F.when(F.col("__read"), F.col("__yes")).otherwise(0))
    return votes.groupBy(*by).agg(F.max("__n").cast("long").alias("total"), F.count_if("__read").alias("checked"), yes.cast("long").alias("scanned_pages"), (yes >= F.max("__t")).alias("scanned"))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two gray images: uniform windows of 7 x 7, sample covariance, without a border of 3."""
    if min(a.shape) < 7:
        raise ValueError("an image is smaller than the window")

    def means(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[7:, 7:] - s[:-7, 7:] - s[7:, :-7] + s[:-7, :-7]) / 49

    a, b = a.astype(float), b.astype(float)
    ma, mb, c1, c2 = means(a), means(b), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    va, vb, vab = ((means(x) - m) * 49 / 48 for x, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def page_similarity(pairs: DataFrame, width: int, height: int) -> DataFrame:
    """pairs (key, before, after: gray images as bytes, row by row) with similarity."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image = lambda x: np.frombuffer(bytes(x), np.uint8).reshape(height, width)
        for got in batches:
            yield pd.DataFrame({"key": got["key"], "similarity": [ssim(image(x), image(y)) for x, y in zip(got["before"], got["after"], strict=True)]})

    return pairs.select("key", "before", "after").mapInPandas(measured, "key long, similarity double")
