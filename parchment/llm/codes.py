"""Vector code compression: product quantisation with integer arithmetic, its rounds sped up by metric trees.

Vectors are cut into parts, and each part position has a codebook. Chunks of vectors are written once, each with a
metric tree for each part position. A tree is built middle-out: anchors take the points nearest to them, anchors are merged
pairwise into balls up to the root, and the points of an anchor are split the same way further down. Balls hold
the sum and the count of their points. In a round a tree is walked from its root with the list of all entries; a ball
inherits the list of its parent and strikes out the entries that are farther than another one from all its points. A ball with
one entry left is owned: its sum and count go to the entry, and no point of it is looked at.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from parchment.llm.common import column, join_groups, packed, unpacked, write_table

#: A component x counts as floor(SCALE * x).
SCALE = 4096
#: Points of a ball that is not split further.
LEAF = 24
#: Components up to here leave room for squared distances in 64 bits; larger ones are counted in Python's whole numbers.
_SMALL = 1 << 24


class Tree:
    """Balls over points, as arrays: range of points, two children (-1: none), centre, radius, sum of the points."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.found = points.astype(np.float64), []
        top = self._ball(np.arange(len(points)))
        order: list[np.ndarray] = []
        rows: list[tuple] = []
        self._number(top, order, rows, 0)
        self.order = np.concatenate(order)
        self.low, self.high, self.left, self.right = np.array([r[:4] for r in rows], np.int64).T
        self.centre, self.radius = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        sums = np.concatenate((np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points[self.order], axis=0)))
        self.sums = sums[self.high] - sums[self.low]
        del self.points, self.found

    def _enclosing(self, at: np.ndarray, children: tuple) -> tuple:
        own = self.points[at]
        centre = own.mean(axis=0)
        return at, children, centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))

    def _ball(self, at: np.ndarray) -> tuple:
        """The ball of these points: anchors, balls below them, and these merged up to one."""
        if len(at) <= LEAF:
            return self._enclosing(at, ())
        anchors = self._anchors(at)
        if len(anchors) == 1:  # all points are equal
            return self._enclosing(at, ())
        return self._merged([self._ball(own) for own in anchors])

    def _anchors(self, at: np.ndarray) -> list[np.ndarray]:
        """About as many anchors as the root of the number of points, each with the points nearest to it.

        A new anchor is the farthest point of the widest one. Points of an anchor, farthest first, come into question
        only while they are more than half as far from it as it is from the new one.
        """
        points = self.points
        far = np.sqrt(((points[at] - points[at[0]]) ** 2).sum(axis=1))
        by = np.argsort(-far, kind="stable")
        owned = [(at[0], at[by], far[by])]
        for _ in range(int(np.sqrt(len(at)))):
            widest = max(range(len(owned)), key=lambda k: owned[k][2][0])
            if owned[widest][2][0] == 0:
                break
            new = owned[widest][1][0]
            taken, taken_far = [], []
            for k, (anchor, own, own_far) in enumerate(owned):
                between = np.sqrt(((points[anchor] - points[new]) ** 2).sum())
                n = int(np.searchsorted(-own_far, -between / 2, side="left"))
                if n:
                    to_new = np.sqrt(((points[own[:n]] - points[new]) ** 2).sum(axis=1))
                    goes = to_new < own_far[:n]
                    if goes.any():
                        taken.append(own[:n][goes])
                        taken_far.append(to_new[goes])
                        stays = np.concatenate((~goes, np.ones(len(own) - n, bool)))
                        owned[k] = anchor, own[stays], own_far[stays]
            own, own_far = np.concatenate(taken), np.concatenate(taken_far)
            by = np.argsort(-own_far, kind="stable")
            owned.append((new, own[by], own_far[by]))
        return [own for _, own, _ in owned]

    def _merged(self, balls: list[tuple]) -> tuple:
        """One ball of all: again and again the two whose common ball is the smallest are made one."""
        while len(balls) > 1:
            centres, radii, n = np.array([b[2] for b in balls]), np.array([b[3] for b in balls]), np.array([len(b[0]) for b in balls], float)
            apart = np.sqrt(np.maximum(0, ((centres[:, None] - centres[None]) ** 2).sum(axis=2)))
            share = n[None] / (n[:, None] + n[None])  # the common centre lies so far from the first to the second
            width = np.maximum(apart * share + radii[:, None], apart * (1 - share) + radii[None])
            np.fill_diagonal(width, np.inf)
            pairs, used, new = np.argsort(width, axis=None, kind="stable"), set(), []
            # of pairs that have no ball in common, the narrower half is merged at once
            for flat in pairs[: len(balls)]:
                i, j = divmod(int(flat), len(balls))
                if i not in used and j not in used:
                    used |= {i, j}
                    new.append(self._enclosing(np.concatenate((balls[i][0], balls[j][0])), (balls[i], balls[j])))
            balls = [b for k, b in enumerate(balls) if k not in used] + new
        return balls[0]

    def _number(self, ball: tuple, order: list[np.ndarray], rows: list[tuple], low: int) -> int:
        at, children, centre, radius = ball
        own = len(rows)
        rows.append(())
        left = right = -1
        if children:
            left = self._number(children[0], order, rows, low)
            right = self._number(children[1], order, rows, low + len(children[0][0]))
        else:
            order.append(at)
        rows[own] = low, low + len(at), left, right, centre, radius
        return own

    def assign(self, points: np.ndarray, entries: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry count and sum of its points; and, if whole, each point's entry, else nothing.

        Entries and points are whole numbers, and nearest is decided by these where it's close: a ball strikes out an entry only
        if the bound shows it by more than rounding can account for. Of equally near entries the first one is taken.
        """
        k = len(entries)
        counts, sums, code = np.zeros(k, np.int64), np.zeros(entries.shape, entries.dtype), np.zeros(len(points) if whole else 0, np.int64)
        plain = entries.astype(np.float64)
        gaps = np.sqrt(((plain[:, None] - plain[None]) ** 2).sum(axis=2))
        first = [not any((entries[i] == entries[j]).all() for i in range(j)) for j in range(k)]
        balls, lists = np.zeros(1, np.int64), np.array([first])
        loose: list[tuple[np.ndarray, np.ndarray]] = []
        while len(balls):
            far = ((self.centre[balls][:, None] - plain[None]) ** 2).sum(axis=2)
            far[~lists] = np.inf
            best = far.argmin(axis=1)
            nearest = far[np.arange(len(balls)), best]
            # the bisector of two entries is (far - nearest) / (2 * gap) away from the centre
            slack = 1e-6 + 1e-9 * np.where(np.isfinite(far), far, 0).max(axis=1)
            lists = lists & ~(far - nearest[:, None] > 2 * self.radius[balls][:, None] * gaps[best] * (1 + 1e-9) + slack[:, None])
            owned = lists.sum(axis=1) == 1
            for ball, entry in zip(balls[owned], best[owned], strict=True):
                counts[entry] += self.high[ball] - self.low[ball]
                sums[entry] += self.sums[ball]
                if whole:
                    code[self.order[self.low[ball] : self.high[ball]]] = entry
            inner = ~owned & (self.left[balls] >= 0)
            loose += [(self.order[self.low[b] : self.high[b]], own) for b, own in zip(balls[~owned & ~inner], lists[~owned & ~inner], strict=True)]
            balls, lists = np.concatenate((self.left[balls[inner]], self.right[balls[inner]])), np.concatenate((lists[inner], lists[inner]))
        if loose:
            at, allowed = np.concatenate([a for a, _ in loose]), np.repeat(np.array([own for _, own in loose]), [len(a) for a, _ in loose], axis=0)
            own = points[at]
            far = ((own[:, None] - entries[None]) ** 2).sum(axis=2)
            far[~allowed] = far.max() + 1
            entry = far.argmin(axis=1)
            if whole:
                code[at] = entry
            np.add.at(counts, entry, 1)
            np.add.at(sums, entry, own)
        return counts, sums, code


def scaled(vectors: list | np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, exactly: SCALE is a power of two."""
    whole = np.floor(np.asarray(vectors, np.float64) * SCALE)
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise ValueError(f"components of {2**62 // SCALE} or more have no code")
    whole = whole.astype(np.int64)
    return whole if not len(whole) or np.abs(whole).max() <= _SMALL else whole.astype(object)


def _usable(vector_col: str) -> Column:
    v = column(vector_col)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _chunks(df: DataFrame, parts: int, chunk_rows: int) -> DataFrame:
    """Vectors in chunks of chunk_rows at most, as they come: their rows, whole numbers and the trees of all part positions."""
    rows_type = ArrayType(df.schema["row"].dataType)

    def made(rows: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        points = scaled(vectors)
        trees = [Tree(p) for p in np.split(points, parts, axis=1)]
        own = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([own, pa.array([pickle.dumps((points, trees), 5)], pa.binary())], ["rows", "trees"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vectors, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                piece = batch.slice(at, chunk_rows)
                if n + piece.num_rows > chunk_rows:
                    yield made(pa.concat_arrays(rows), np.concatenate(vectors))
                    rows, vectors, n = [], [], 0
                got = piece.column("vector")
                rows.append(piece.column("row"))
                vectors.append(got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1))
                n += piece.num_rows
        if n:
            yield made(pa.concat_arrays(rows), np.concatenate(vectors))

    return write_table(df.mapInArrow(chunked, StructType([StructField("rows", rows_type), StructField("trees", BinaryType())])), "vector-chunks")


def _arrays(books: list[list[list[int]]], small: bool) -> list[np.ndarray]:
    return [np.array(b, np.int64 if small and max(abs(x) for e in b for x in e) <= 2 * _SMALL else object) for b in books]


def _both(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with whole numbers of 64 bits, or both of any size."""
    return (points, entries) if points.dtype == entries.dtype else (points.astype(object), entries.astype(object))


def _round(chunks: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round; entries that no part is nearest to stay."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, total = _arrays(books, True), {}
        for batch in batches:
            for blob in batch.column("trees"):
                points, trees = pickle.loads(blob.as_py())
                for p, (tree, own) in enumerate(zip(trees, np.split(points, len(trees), axis=1), strict=True)):
                    counts, sums, _ = tree.assign(*_both(own, arrays[p]), whole=False)
                    for e in np.flatnonzero(counts):
                        n, s = total.get((p, int(e)), (0, [0] * own.shape[1]))
                        total[p, int(e)] = n + int(counts[e]), [x + int(y) for x, y in zip(s, sums[e], strict=True)]
        keys, values = list(total), list(total.values())
        columns = [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([n for n, _ in values], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([[Decimal(x) for x in s] for _, s in values], pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])

    partial = chunks.select("trees").mapInArrow(summed, "part int, entry int, n bigint, sums array<decimal(38,0)>")
    dim = len(books[0][0])
    sums = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).cast("decimal(38,0)").alias(f"s{i}") for i in range(dim)])
    new = [[list(e) for e in book] for book in books]
    for r in sums.collect():  # a row for each entry of each codebook
        new[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    return new


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, chunk_rows: int = 2048) -> tuple[DataFrame, list[list[list[int]]]]:
    """The rows of df that have a code, with code and error in place of the vector; and the codebooks by part, entry and component.

    Rows whose vector is null or holds a null, NaN or infinity go. Components count as floor(4096 * x). A codebook starts as that part
    of the vectors with the smallest ids (null last, equal ids in order of the vector), fewer than entries if there are fewer rows.
    In each round a part goes to its nearest entry, the first of several, and entries become the floor of the mean of
    their parts; the last codes are those after all rounds. code has two hexadecimal digits for each part, error
    is the sum of the squared distances, null if that takes over 63 bits. The result is exact: trees only save work.

    All vectors must have the length of the first one, a multiple of parts, or ValueError is raised, as it is for components
    of 2**50 or more. No usable rows give no rows and no codebooks. Columns of df named code or error are replaced; other names are free.

    Chunks are dealt as the rows come, so no id or vector can be hot; equal vectors are one ball. A task holds one chunk at a
    time. A round sends at most parts * entries rows from each task, which are added up before the driver divides them.
    """
    kept = df.filter(_usable(vector_col))
    start = [list(r[0]) for r in kept.orderBy(column(id_col).asc_nulls_last(), column(vector_col)).select(column(vector_col)).limit(entries).collect()]
    out_type = StructType([*[f for f in df.schema if f.name.lower() not in (vector_col.lower(), "code", "error")]]).add("code", "string").add("error", "long")
    if not start:
        return df.sparkSession.createDataFrame([], out_type), []
    dim = len(start[0])
    if not dim or dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} parts")
    sized = F.when(F.size(column(vector_col)) == dim, column(vector_col)).otherwise(F.raise_error(F.lit(f"not all vectors have {dim} components")).cast(df.schema[vector_col].dataType))
    chunks = _chunks(kept.select(packed(df, vector_col, "code", "error"), sized.alias("vector")), parts, chunk_rows)
    if any(len(v) != dim for v in start):
        raise ValueError(f"not all vectors have {dim} components")
    books = [[[int(x) for x in e] for e in p] for p in np.split(scaled(start), parts, axis=1)]
    for _ in range(rounds):
        books = _round(chunks, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays(books, True)
        for batch in batches:
            for rows, blob in zip(batch.column("rows"), batch.column("trees"), strict=True):
                points, trees = pickle.loads(blob.as_py())
                code, error = np.zeros((len(points), parts), np.int64), 0
                for p, (tree, own) in enumerate(zip(trees, np.split(points, parts, axis=1), strict=True)):
                    own, book = _both(own, arrays[p])
                    code[:, p] = tree.assign(own, book, whole=True)[2]
                    error = error + ((own - book[code[:, p]]) ** 2).sum(axis=1)
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                fits = [int(e) if e < 1 << 63 else None for e in error]
                yield pa.RecordBatch.from_arrays([rows.values, pa.array(text), pa.array(fits, pa.int64())], ["row", "code", "error"])

    out = chunks.mapInArrow(coded, StructType([StructField("row", kept.select(packed(df, vector_col, "code", "error")).schema["row"].dataType)]).add("code", "string").add("error", "long"))
    return out.select(*unpacked(out), "code", "error"), books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal digits, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_group_error(coded: DataFrame, label_col: str, out: str = "label_error") -> DataFrame:
    """coded with the sum of error over the rows of equal labels, null ones together; a sum of over 63 bits is null.

    coded is written and read back. A label may be on any share of the rows: see join_groups.
    """
    keys = [F.col(f"row.{label_col}").isNull().alias("none"), F.coalesce(F.col(f"row.{label_col}").cast("string"), F.lit("")).alias("key")]
    rows = write_table(coded.select(packed(coded, out)).select("row", *keys, F.col("row.error").alias("own")), "vector-codes")
    groups = write_table(rows.groupBy("none", "key").agg(F.count("*").alias("n"), F.try_sum("own").alias("sum")), "label-errors")
    met = join_groups(rows, groups, ["none", "key"], "n", F.monotonically_increasing_id())
    return met.select(*unpacked(met), F.col("sum").alias(out))
