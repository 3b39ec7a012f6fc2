"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of the whole text.

Counts decide at each level which rows go on. A row whose length is its own is a text of its own and has nothing
hashed. Rows of shared lengths have their first characters hashed, and a row whose length and prefix hash are its own
ends there. Only the rest has its whole text hashed and grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import column, join_groups, write_table

WHITESPACE = " \t\n\x0b\x0c\r"


def normalised(text_col: str = "text") -> Column:
    """The text without spaces and the characters U+0009 to U+000D; null counts as empty."""
    return F.translate(F.coalesce(column(text_col), F.lit("")), WHITESPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, columns: list[str] | None = None) -> DataFrame:
    """The columns of docs (all, or those asked for), and for each row keep_id, group_size and kept.

    Texts are equal when their normalised forms are. Of equal texts the row with the most code points in the original
    text stays, then the one with the smallest id (a null id comes first), then one of the rows that repeat it.
    Null and empty texts are equal. An empty table gives no rows. Columns of docs named as the new ones are replaced;
    other names are free.

    The first scan takes length and first characters of each text; the first two levels count those. The
    second scan deals texts by length and prefix hash, so that a text is hashed where its group is at least two rows.
    Groups larger than a quarter of a partition are never dealt by their key: see join_groups. Columns that are not asked for, the text
    among them, are not written.
    """
    bare = normalised(text_col)
    heads = write_table(docs.select(F.char_length(bare).alias("len"), F.substring(bare, 1, prefix_chars).alias("head")), "exact-heads")
    lengths = write_table(heads.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1"), "exact-lengths")
    shared = join_groups(heads.withColumn("at", F.monotonically_increasing_id()), lengths, ["len"], "n", F.col("at"), how="inner")
    cells = shared.groupBy("len", F.xxhash64("head").alias("prefix")).agg(F.count("*").alias("cell")).filter("cell > 1")
    cells = write_table(cells, "exact-cells")

    # columns travel by number rather than in a struct, so that those that nobody asks for are never shuffled
    names = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept") and (columns is None or c in columns)]
    numbers = [f"c{k}" for k in range(len(names))]
    body = next((k for c, k in zip(names, numbers, strict=True) if c.lower() == text_col.lower()), "text")
    rows = docs.select(
        *[column(c).alias(k) for c, k in zip(names, numbers, strict=True)],
        *([column(text_col).alias("text")] if body == "text" else []),
        column(id_col).alias("id"),
        F.char_length(bare).alias("len"),
        F.xxhash64(F.substring(bare, 1, prefix_chars)).alias("prefix"),
        F.monotonically_increasing_id().alias("at"),
    )
    hashed = join_groups(rows, cells, ["len", "prefix"], "cell", F.col("at"))
    text = F.coalesce(F.col(body), F.lit(""))
    full = F.when(F.col("cell").isNotNull(), F.sha2(F.encode(F.translate(text, WHITESPACE, ""), "utf-8"), 256))
    hashed = write_table(hashed.select(*numbers, "id", "at", F.char_length(text).alias("chars"), full.alias("full")), "exact-hashed")

    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id"), F.col("at"))).alias("best")
    groups = hashed.filter(F.col("full").isNotNull()).groupBy("full").agg(best, F.count("*").alias("size"))
    groups = write_table(groups.filter("size > 1"), "exact-groups")
    alone = F.col("best").isNull()
    return join_groups(hashed, groups, ["full"], "size", F.col("at")).select(
        *[F.col(k).alias(c) for c, k in zip(names, numbers, strict=True)],
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.at") == F.col("at"))).alias("kept"),
    )
