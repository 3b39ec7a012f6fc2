"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parchment.llm.common import column, write_table

#: Permitted lengths, in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)


def bin_cost(length: int) -> float:
    """Cost of a sequence: linear work for each token, and attention, which grows with the square; plus a fixed share."""
    return length + length * length / 65536 + 16


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...], open_from: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack items, largest first, each into the open bin that it fills best; if none has room, a new one is opened.

    New bins have the length, of those that hold the item and are open_from at least, with the least cost for a token.
    At the end each bin shrinks to the least length that holds what it has. Returns for each item its bin and
    offset, and for each bin its length and its contents.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            fitting = [x for x in lengths if x >= size and x >= open_from] or [x for x in lengths if x >= size]
            left, b = min(fitting, key=lambda x: (bin_cost(x) / x, x)), len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    contents = np.array(used, np.int64)
    return bins, offsets, np.asarray(lengths)[np.searchsorted(lengths, contents)], contents


def pack(docs: DataFrame, tokens: Column, id_col: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, pool_rows: int = 8192) -> DataFrame:
    """Where each text goes: id, part, start, n_tokens, bin, bin_length, bin_tokens and bin_offset.

    tokens is the number of tokens of a row; null or less than 1 makes no part. A text longer than the greatest
    length is cut into parts of that length and a rest; start is the first token of a part. Parts are dealt evenly
    by hash into pools of about pool_rows, which are packed apart from each other: memory is bounded, a pool wastes
    a few bins at most, and no key can be hot, as the hash takes in the part and the place of the row in the table of counts,
    in which rows that repeat another have places of their own. For each pool every permitted length
    is tried as the least to open, and the plan of least total cost is kept. A bin is named "<pool>-<number>".
    Rows that repeat an id get bins of their own, part by part. No rows give no bins. Tokens are counted once: ids and
    counts are written to the shared folder. Ids are of any type that can be sorted; those equal to others are kept as they are.
    """
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    rows = write_table(docs.select(column(id_col).alias("id"), tokens.cast("long").alias("tokens")).filter("tokens > 0"), "token-counts")
    parts = rows.withColumn("row", F.monotonically_increasing_id()).select("id", "row", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {top}"))).alias("part"))
    parts = parts.select("id", "row", "part", (F.col("part") * top).alias("start"), F.least(F.lit(top), F.col("tokens") - F.col("part") * top).alias("n_tokens"))
    n = rows.agg(F.sum(F.expr(f"(tokens - 1) div {top} + 1"))).first()[0] or 0
    pools = max(1, round(n / pool_rows))

    def packed(got: pa.Table) -> pa.Table:
        got = got.take(pc.sort_indices(got, [("n_tokens", "descending"), ("id", "ascending"), ("part", "ascending")]))
        plans = [best_fit(got["n_tokens"].to_numpy(), lengths, least) for least in lengths]
        bins, offsets, chosen, contents = min(plans, key=lambda p: sum(map(bin_cost, p[2].tolist())))
        name = pa.array([f"{p}-{b}" for p, b in zip(got["pool"].to_pylist(), bins.tolist(), strict=True)])
        # ids stay as they are: pandas would make numbers beside a null floats
        new = [name, *(pa.array(x, pa.int64()) for x in (chosen[bins], contents[bins], offsets))]
        return pa.table([*(got[c] for c in ("id", "part", "start", "n_tokens")), *new], ["id", "part", "start", "n_tokens", "bin", "bin_length", "bin_tokens", "bin_offset"])

    out_type = StructType([StructField("id", rows.schema["id"].dataType)])
    for c in ("part", "start", "n_tokens", "bin", "bin_length", "bin_tokens", "bin_offset"):
        out_type = out_type.add(c, "string" if c == "bin" else "long")
    dealt = parts.withColumn("pool", F.pmod(F.xxhash64("id", "part", "row"), F.lit(pools))).drop("row")
    out = dealt.groupBy("pool").applyInArrow(packed, out_type)
    return out.withColumnRenamed("id", id_col)
