"""Greedy batches of paragraphs: packing by thresholds, and pairs across pages and columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parchment.functions.predicates import is_cid, is_numeric, is_placeholder_only

#: Tokens and paragraphs that a batch may pass before it is closed: for term extraction and for translation.
TERMS, TRANSLATE = (600, 12), (200, 5)
#: Labels of running text.
BODY_LABELS = ("text", "plain text", "paragraph_hybrid")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each document, numbered from 0."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("ord", "line"))


def word_tokens(text: Column) -> Column:
    """The default measure of a text: its words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def pack(items: Column, max_tokens: int, max_items: int) -> Column:
    """Batches of items (ord, tokens), which are in order: array of tokens and ords.

    An item is added to the open batch, which is closed when it then has more than max_tokens or max_items. So a
    batch has up to max_items + 1 items. Zero items make no batch, null items null. Batches are found in the running sums of tokens, a jump for
    each batch, so time is in proportion to the items.
    """
    kind = pa.list_(pa.struct([("tokens", pa.int64()), ("ords", pa.list_(pa.int32()))]))

    @F.arrow_udf("array<struct<tokens:bigint,ords:array<int>>>")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            out = []
            for row in rows:
                if not row.is_valid:
                    out.append(None)
                    continue
                ords, sums = row.values.field("ord").to_pylist(), np.concatenate(([0], np.cumsum(row.values.field("tokens").to_numpy(zero_copy_only=False))))
                at, made = 0, []
                while at < len(ords):
                    over = int(np.searchsorted(sums, sums[at] + max_tokens, side="right"))
                    end = min(over, at + max_items + 1, len(ords))
                    made.append({"tokens": int(sums[end] - sums[at]), "ords": ords[at:end]})
                    at = end
                out.append(made)
            yield pa.array(out, kind)

    return packed(F.transform(items, lambda x: F.struct(x["ord"].cast("int").alias("ord"), x["tokens"].cast("long").alias("tokens"))))


def pack_lines(docs: DataFrame, max_tokens: int, max_items: int, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batches of each document's lines for which keep holds: id, batch from 0, tokens, n_items, first and last line.

    A document is a row, so nothing is shuffled.
    """
    items = F.transform(F.split(F.col(text_col), "\n", -1), lambda t, i: F.struct(i.alias("ord"), word_tokens(t).cast("long").alias("tokens"), keep(t).alias("keep")))
    batches = docs.select(F.col(id_col), F.posexplode(pack(F.filter(items, lambda x: x["keep"]), max_tokens, max_items)).alias("batch", "b"))
    return batches.select(id_col, F.col("batch").cast("long").alias("batch"), "b.tokens", F.size("b.ords").cast("long").alias("n_items"), F.element_at("b.ords", 1).cast("long").alias("first"), F.element_at("b.ords", -1).cast("long").alias("last"))


def submission_order(batches: DataFrame, by: list[str], seq: list[str]) -> DataFrame:
    """place: in which order the batches of a group are sent: those of most tokens first, then as they were made."""
    return batches.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("tokens"), *seq)).cast("long"))


def title_context(rows: DataFrame, by: list[str], order: list[str], is_title: Column, text: Column) -> DataFrame:
    """title: the group's first title; local_title: the last one up to the row, itself included, or else the first."""
    titled = F.when(is_title, text)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(titled, ignorenulls=True).over(whole)
    return rows.withColumns({"title": first, "local_title": F.coalesce(F.last(titled, ignorenulls=True).over(upto), first)})


def cross_page_pairs(pages: DataFrame, by: list[str], page: str, first: str, last: str, n: str) -> DataFrame:
    """Pairs of a page's last and the next page's first paragraph, taken greedily from the first page on.

    pages has a row for each page of a group: its number of eligible paragraphs n and the first and last of them. A
    paragraph is in one pair at most, so only pages with a single one depend on the pair before: among pages in
    a row that have one each, every other is paired. That makes it a window computation.
    """
    order = Window.partitionBy(*by).orderBy(page)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(order)
    look = pages.withColumns({"__at": at, "__next_n": F.coalesce(F.lead(n).over(order), F.lit(0)), "__head": F.lead(first).over(order), "next_page": F.lead(page).over(order)})
    anchor = F.last(F.when(F.col(n) != 1, F.struct(F.col("__at").alias("at"), (F.col(n) > 1).alias("pairs"))), ignorenulls=True).over(upto)
    look = look.withColumn("__anchor", F.coalesce(anchor, F.struct(F.lit(0).alias("at"), F.lit(False).alias("pairs"))))
    odd = (F.col("__at") - F.col("__anchor.at")) % 2 == 1
    taken = F.when(F.col(n) > 1, True).when(F.col(n) == 0, False).otherwise(odd != F.col("__anchor.pairs"))
    return look.filter(taken & (F.col("__next_n") > 0)).select(*by, page, "next_page", F.col(last).alias("last"), F.col("__head").alias("head"))


def cross_column_pairs(rows: DataFrame, by: list[str], order: str, top: str, jump: float = 20) -> DataFrame:
    """Adjacent paragraphs of a page whose tops rise by more than jump, each in one pair at most, from the first on.

    In a run of jumps in a row every other one makes a pair.
    """
    w = Window.partitionBy(*by).orderBy(order)
    looked = rows.withColumns({"__next": F.lead(order).over(w), "__jump": F.coalesce(F.lead(top).over(w) - F.col(top) > jump, F.lit(False)), "__at": F.row_number().over(w)})
    start = F.coalesce(F.max(F.when(~F.col("__jump"), F.col("__at"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    looked = looked.withColumn("__odd", (F.col("__at") - start) % 2 == 1)
    return looked.filter(F.col("__jump") & F.col("__odd")).select(*by, order, F.col("__next").alias("pair"))


def plan_batches(rows: DataFrame, by: list[str], page: str, order: str, measure=word_tokens, least_chars: int = 5, limits: tuple[int, int] = TRANSLATE) -> DataFrame:
    """The batches in which a document's paragraphs are sent: by, seq from 0, kind, tokens, items (page and order of each), title, local_title.

    rows are paragraphs (text, label, top) by document, page and order. First, pairs across pages, then pairs across columns, both of running
    text (BODY_LABELS), then what is left of each page is packed. A paragraph is in one batch at most: what a pass has used is not there for
    the next one. Texts under least_chars and of CID codes are never sent; numbers and bare placeholders only in pairs. title
    is the document's first title, local_title the last one that packing had met when the batch was closed, or else the first; pairs have the first.

    Pages are grouped and packed each by itself; documents are only ordered, by windows. Null texts count as empty, null labels are no label.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = [page, order]
    rows = rows.select(*by, *at, text.alias("text"), "label", "top", measure(text).cast("long").alias("tokens"))
    eligible = ~is_cid(F.col("text")) & (F.char_length("text") >= least_chars)
    body = rows.filter(eligible & F.col("label").isin(*BODY_LABELS)).select(*by, *at, "top", "tokens")
    pages = rows.select(*by, page).distinct().join(body.groupBy(*by, page).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")), [*by, page], "left").fillna(0, ["n"])
    place = lambda p, o: F.struct(F.col(p).alias("page"), F.col(o).alias("ord"))
    pairs = cross_page_pairs(pages, by, page, "first", "last", "n").select(*by, F.lit("pages").alias("kind"), F.array(place(page, "last"), place("next_page", "head")).alias("items"))
    in_pairs = lambda p: p.select(*by, F.explode("items").alias("i")).select(*by, F.col("i.page").alias(page), F.col("i.ord").alias(order))
    used = in_pairs(pairs)
    columns = cross_column_pairs(body.join(used, [*by, *at], "left_anti"), [*by, page], order, "top").select(*by, F.lit("columns").alias("kind"), F.array(place(page, order), place(page, "pair")).alias("items"))
    pairs = pairs.unionByName(columns)
    used = used.unionByName(in_pairs(columns))

    document = Window.partitionBy(*by).orderBy(*at)
    titled = F.when(F.col("label") == "title", F.col("text"))
    first = rows.groupBy(*by).agg(F.min_by(titled, F.when(titled.isNotNull(), F.struct(*at))).alias("title"))
    left = rows.filter(eligible & ~is_numeric(F.col("text")) & ~is_placeholder_only(F.col("text"))).join(used, [*by, *at], "left_anti")
    left = left.select(*by, *at, "tokens", F.last(titled, ignorenulls=True).over(document.rowsBetween(Window.unboundedPreceding, 0)).alias("recent"))
    packed = left.groupBy(*by, page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("tokens"), F.col("recent")))).alias("own"))
    # the items of a page by their places, from which a batch takes its orders and the last title
    items = F.transform("own", lambda x, i: F.struct(i.alias("ord"), x["tokens"].alias("tokens")))
    packed = packed.select(*by, page, "own", F.posexplode(pack(items, *limits)).alias("batch", "b"))
    of = F.transform("b.ords", lambda i: F.struct(F.col(page).alias("page"), F.get("own", i)["o"].alias("ord")))
    packed = packed.select(*by, F.lit("page").alias("kind"), of.alias("items"), F.col("b.tokens").alias("tokens"), F.get("own", F.element_at("b.ords", -1))["recent"].alias("recent"))

    sized = pairs.select(*by, "kind", "items", F.explode("items").alias("i")).join(body.select(*by, F.struct(F.col(page).alias("page"), F.col(order).alias("ord")).alias("i"), "tokens"), [*by, "i"])
    sized = sized.groupBy(*by, "kind", "items").agg(F.sum("tokens").alias("tokens")).withColumn("recent", F.lit(None).cast("string"))
    pass_of = F.when(F.col("kind") == "pages", 0).when(F.col("kind") == "columns", 1).otherwise(2)
    made = sized.unionByName(packed.select(*sized.columns)).withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(pass_of, F.get("items", F.lit(0)))).cast("long") - 1)
    return made.join(first, by).select(*by, "seq", "kind", "tokens", "items", "title", F.coalesce("recent", "title").alias("local_title"))


def style_runs(chars: DataFrame, by: list[str], order: str, slack: float = 0.02) -> DataFrame:
    """Runs of consecutive characters of one style (kind, font, size and graphics state), which formulas break.

    A character goes on with a run if its size differs by less than slack from that of the run's first one. Characters are read in
    order by one task, which holds the run that it is in and gives it out when it ends.
    """
    n, given = len(by), dict(chars.dtypes)
    out = StructType([*chars.select(*by).schema.fields, *StructType.fromDDL(f"run long, first {given[order]}, last {given[order]}, font string, size {given['size']}, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, here, style, size, number, open_run = to_arrow_schema(out), None, None, None, 0, None
        for got in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in got.columns), strict=True):
                key, at, now, wide = row[:n], row[n], row[n + 1 : n + 4], row[n + 4]
                if key != here or now != style or wide is None or size is None or abs(wide - size) >= slack:
                    if open_run:
                        made.append(tuple(open_run))
                    number = number + 1 if key == here else 1
                    here, style, size = key, now, wide
                    open_run = [*key, number, at, at, now[1], wide, 0]
                open_run[n + 2] = at
                open_run[-1] += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)
        if open_run:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(open_run, kinds, strict=True)], schema=kinds)

    rows = chars.select(*by, order, "kind", "font", "gstate", "size")
    return rows.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, out)


def wrap_lines(words: Column, width: int) -> Column:
    """Greedy line layout: words (text) one after another, a line closed when the next does not fit; array of lines."""

    @F.arrow_udf("array<string>")
    def wrapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                lines, line, size = [], [], -1
                for word in row or []:
                    if line and size + 1 + len(word) > width:
                        lines.append(" ".join(line))
                        line, size = [], -1
                    line.append(word)
                    size += 1 + len(word)
                out.append(None if row is None else [*lines, " ".join(line)] if line else lines)
            yield pa.array(out, pa.list_(pa.string()))

    return wrapped(words)
