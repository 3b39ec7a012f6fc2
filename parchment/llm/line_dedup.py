"""Line dedup: repeated windows of three lines lose all but their first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import column, inside, join_groups, packed, write_table

#: What is cut from both ends of a line before it is compared; a line of these only is blank.
BLANKS = " \t\r"
_RANGES = "array<struct<first:int,last:int>>"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """docs with repeated passages cut out of the text column, and n_lines, n_removed and removed.

    A window is so many consecutive lines that aren't blank, compared without blanks at their ends. Of windows
    with equal lines, in one document or many, the first by id (null first), then by hash of the text, then by line
    stays, and every other one is covered from its first line to its last, blank lines between included. Covered
    lines go; overlapping covers merge. removed has the covered ranges of line numbers, from 0, first and last.
    A text without three such lines has no window. Null texts stay null. Rows that repeat both id and text count as
    one document and stay alike. Columns of docs with the new names are replaced; other names are free.

    Windows travel as two 64-bit hashes; texts are shuffled once, to meet the cuts of their document. A window
    that very many documents share is found by counting, then broadcast: see join_groups. Time and memory of a document
    are in proportion to its lines.
    """
    line_hashes = F.filter(
        F.transform(
            F.split(column(text_col), "\n", -1),
            lambda x, i: F.struct(i.alias("at"), (F.btrim(x, F.lit(BLANKS)) != "").alias("filled"), F.xxhash64(F.btrim(x, F.lit(BLANKS))).alias("a"), F.xxhash64(F.lit("b"), F.btrim(x, F.lit(BLANKS))).alias("b")),
        ),
        lambda x: x["filled"],
    )
    lines = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("text"), line_hashes.alias("lines")).filter(F.size("lines") >= window)
    at = lambda i, name: F.element_at("lines", i)[name]
    windows = lines.select(
        "id",
        "text",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("lines") - window + 1),
                lambda i: F.struct(
                    at(i, "at").alias("first"), at(i + window - 1, "at").alias("last"), F.xxhash64(*[at(i + k, "a") for k in range(window)]).alias("a"), F.xxhash64(*[at(i + k, "b") for k in range(window)]).alias("b")
                ),
            )
        ).alias("w"),
    ).select("id", "text", "w.*")
    windows = write_table(windows, "windows")

    where = F.struct("id", "text", "first")
    repeated = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(where).alias("keep")).filter("n > 1")
    repeated = write_table(repeated, "repeated-windows")
    cuts = join_groups(windows, repeated, ["a", "b"], "n", F.xxhash64(where), how="inner").filter(~F.col("keep").eqNullSafe(where))
    # rows that repeat id and text cut the same windows: their number is that of all cuts by that of different ones
    name = lambda c: [c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("key")]
    cuts = cuts.groupBy(*name(F.col("id")), "text").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("cuts"), F.count("*").alias("n"))
    cuts = write_table(cuts.withColumn("n", F.expr("n div size(cuts)")), "cuts")

    keyed = docs.select(packed(docs, "n_lines", "n_removed", "removed"), *name(column(id_col)), F.xxhash64(column(text_col)).alias("text"))
    met = join_groups(keyed, cuts, ["none", "key", "text"], "n", F.monotonically_increasing_id(), shuffle=True).select("row", F.coalesce("cuts", F.array().cast(_RANGES)).alias("cuts"))
    # later cuts end no earlier than earlier ones, so a merged cover starts where a cut doesn't reach the one before it,
    # and ends where one isn't reached by the next
    starts = F.filter("cuts", lambda c, i: (i == 0) | (c["first"] > F.get("cuts", i - 1)["last"] + 1))
    ends = F.filter("cuts", lambda c, i: (i == F.size("cuts") - 1) | (F.get("cuts", i + 1)["first"] > c["last"] + 1))
    met = met.select("row", F.zip_with(starts, ends, lambda s, e: F.struct(s["first"].alias("first"), e["last"].alias("last"))).alias("removed"), F.split(inside(text_col), "\n", -1).alias("lines"))
    gone = F.flatten(F.transform("removed", lambda c: F.sequence(c["first"], c["last"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    text = F.when(F.size("removed") == 0, inside(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    columns = [(text if c.lower() == text_col.lower() else inside(c)).alias(c) for c in met.schema["row"].dataType.names]
    return met.select(*columns, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), "removed")
