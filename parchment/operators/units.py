"""Units of pages: translations, styles and page subsets that meet them, totals, and stages that were done before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least and greatest side of a page, in points.
PAGE_SIDES = (50, 14_400)
#: Modes in which glyphs are drawn but not seen.
UNSEEN_MODES = (3, 7)


def unit_key(unit: Column, index: Column) -> Column:
    """How translations name a paragraph: its unit and its place in there."""
    return F.concat(unit, F.lit("#"), index)


def attach(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what was found for their keys (one row each), or nulls."""
    return rows.join(found, keys, "left")


def reattach(units: DataFrame, chars: DataFrame, by: list[str], seq: str = "seq", order: str = "ord") -> DataFrame:
    """Characters in the order of the units (ord) that have their seq, and after those the ones that no unit has; place counts from 0."""
    met = chars.join(units.select(*by, seq, F.col(order).alias("unit_ord")), [*by, seq], "left")
    w = Window.partitionBy(*by).orderBy(F.col("unit_ord").isNull(), "unit_ord", seq)
    return met.withColumns({"matched": F.col("unit_ord").isNotNull(), "place": (F.row_number().over(w) - 1).cast("long")}).drop("unit_ord")


def decode_styles(items: Column, styles: Column) -> Column:
    """Items (text, style: an index from 0, or null) with the style of that index; null where there is none."""
    return F.transform(items, lambda i: F.struct(i["text"].alias("text"), F.when(i["style"] >= 0, F.get(styles, i["style"])).alias("style")))


def provider_view(providers: DataFrame, secrets: DataFrame, presets: DataFrame) -> DataFrame:
    """Providers with has_key, and the preset of their kind, the first by ord."""
    first = presets.groupBy("kind").agg(F.min_by("preset", "ord").alias("preset"))
    keyed = secrets.select("provider_id").distinct().withColumn("key_found", F.lit(True))
    return providers.join(keyed, "provider_id", "left").join(first, "kind", "left").withColumn("has_key", F.coalesce("key_found", F.lit(False))).drop("key_found")


def valid_defaults(defaults: DataFrame, translators: DataFrame) -> DataFrame:
    """Defaults (provider_id, model) that are among the translators there are."""
    return defaults.join(translators, ["provider_id", "model"], "left_semi")


def translators_by_provider(translators: DataFrame) -> DataFrame:
    """The models of each provider by its id, whatever its name, in the order of ord; the first name counts."""
    models = F.transform(F.array_sort(F.collect_list(F.struct("ord", "model"))), lambda m: m["model"])
    return translators.groupBy("provider_id").agg(F.min_by("name", "ord").alias("name"), models.alias("models"), F.min("ord").alias("ord"))


def on_spine(spine: DataFrame, rows: DataFrame, by: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """One row for each page of the spine with items, an array of its rows in order of ord, empty for pages without any.

    With wanted, pages that aren't in it are empty too.
    """
    rows = rows if wanted is None else rows.join(wanted, by, "left_semi")
    rest = [c for c in rows.columns if c not in by]
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in rest if c != "ord"]))).alias("items"))
    kind = grouped.schema["items"].dataType
    return spine.join(grouped, by, "left").withColumn("items", F.coalesce("items", F.array().cast(kind)))


def kept_pages(pages: DataFrame, deleted: DataFrame, by: list[str]) -> DataFrame:
    return pages.join(deleted, by, "left_anti")


def pages_in_both(original: DataFrame, translated: DataFrame, by: list[str]) -> DataFrame:
    """The first pages, as many as the shorter of the two has: by, page, and whether it has one on both sides."""
    return original.join(translated, [*by, "page"], "left_semi")


def by_confidence(boxes: DataFrame, by: list[str], order: str) -> DataFrame:
    """box_idx: the place of a box by falling confidence; of equally sure ones the model's order counts."""
    return boxes.withColumn("box_idx", (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("conf"), order)) - 1).cast("long"))


def id_order(ids: DataFrame, by: list[str], name: str) -> DataFrame:
    """place: the place of an id in its group whatever its case; ids that differ in case alone are in order of their characters."""
    return ids.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy(F.lower(name), name)) - 1).cast("long"))


def analysis_totals(units: DataFrame, by: list[str]) -> DataFrame:
    """Units (paragraphs: array of texts, formulas: how many) in numbers: units, paragraphs, those with text, formulas."""
    filled = F.size(F.filter("paragraphs", lambda p: F.btrim(p) != ""))
    return units.groupBy(*by).agg(F.count("*").alias("units"), F.sum(F.size("paragraphs")).cast("long").alias("paragraphs"), F.sum(filled).cast("long").alias("translatable"), F.sum("formulas").cast("long").alias("formulas"))


def page_size_ok(width: Column, height: Column) -> Column:
    return width.between(*PAGE_SIDES) & height.between(*PAGE_SIDES)


def is_visible(render_mode: Column) -> Column:
    return ~F.coalesce(render_mode, F.lit(0)).isin(*UNSEEN_MODES)


def stage_key(source_sha: Column, stage: Column, pages: Column, version: Column) -> Column:
    """What the result of a stage is kept under: the same source, stage, page scope (null: all) and version of the code."""
    return F.sha2(F.concat_ws("\x1f", source_sha, stage, F.coalesce(pages, F.lit("all")), version), 256)


def with_stage_cache(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work (key) with the newest valid result that is kept for it, and todo where there is none."""
    known = cache.filter("valid").groupBy("key").agg(F.max_by("result", "at").alias("result"))
    return work.join(known, "key", "left").withColumn("todo", F.col("result").isNull())


def upsert(cache: DataFrame, flushed: DataFrame, key: str, at: str) -> DataFrame:
    """The cache after a flush: for each key the newest row, of equally new ones the flushed one."""
    both = cache.withColumn("fresh", F.lit(0)).unionByName(flushed.withColumn("fresh", F.lit(1)))
    rest = [c for c in cache.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "fresh")).alias("row")).select(key, "row.*")
