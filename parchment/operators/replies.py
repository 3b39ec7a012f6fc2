"""Replies of models: quality gates, JSON, caches and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import clean_json_output, collapse_punctuation, strip
from parchment.operators.batching import word_tokens


def rejected_because(source: Column, reply: Column, tokens=word_tokens) -> Column:
    """Why a translation isn't accepted, or null: missing, unchanged, empty source, length, or hardly changed; in this order."""
    a, b = collapse_punctuation(source), collapse_punctuation(reply)
    n, m = tokens(a), tokens(b)
    ratio = m / F.nullif(n, F.lit(0))
    return (
        F.when(reply.isNull(), "missing")
        .when((a == b) & (n > 10), "unchanged")
        .when(n == 0, "empty source")
        .when(~((ratio > 0.3) & (ratio < 3)), "length")
        .when((F.levenshtein(source, b) < 5) & (n > 20), "hardly changed")
    )


def mostly_kept(kept: Column, total: Column) -> Column:
    """Whether too much stayed untranslated: over 400 characters and over a fifth."""
    return (kept > 400) & (kept * 5 > total)


def batch_items(replies: DataFrame, reply: str, expected: Column) -> DataFrame:
    """items: the items (id, output) of a batch reply, or null if it isn't a list of as many different ids from 0 on."""
    kind = "array<struct<id:string,output:string,input:string>>"
    got = replies.withColumns({"__text": clean_json_output(F.col(reply)), "__n": expected})
    got = got.withColumn("__json", F.from_json(F.when(F.col("__text").startswith("{"), F.concat(F.lit("["), "__text", F.lit("]"))).otherwise(F.col("__text")), kind))
    got = got.withColumn("__items", F.transform("__json", lambda r: F.struct(r["id"].try_cast("int").alias("id"), F.coalesce(r["output"], r["input"]).alias("output"))))
    got = got.withColumn("__ids", F.array_distinct(F.col("__items.id")))
    good = F.forall("__ids", lambda i: i.isNotNull() & (i >= 0) & (i < F.col("__n"))) & (F.size("__ids") == F.col("__n"))
    return got.withColumn("items", F.when(good, F.col("__items"))).drop("__text", "__n", "__json", "__items", "__ids")


def extracted_terms(reply: Column) -> Column:
    """The term pairs (src, tgt) of a reply: both filled, source under 100 characters, equal pairs of 3 or more."""
    listed = F.regexp_replace(clean_json_output(reply), r"(?s)\A(?!\[)(.*)\z", "[$1]")
    items = F.from_json(listed, "array<struct<src:string,tgt:string>>")
    pairs = F.transform(items, lambda r: F.struct(strip(r["src"]).alias("src"), strip(r["tgt"]).alias("tgt")))
    return F.filter(pairs, lambda r: (r["src"] != "") & (r["tgt"] != "") & (F.length(r["src"]) < 100) & ~((r["src"] == r["tgt"]) & (F.length(r["src"]) < 3)))


def fake_reply(text: Column, mark: str = " (done)") -> Column:
    """What the stand-in for a model answers: the text with a mark, blank texts as they are."""
    return F.when(strip(text) == "", text).otherwise(F.concat(text, F.lit(mark)))


def prompt_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def with_cached(requests: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Requests (key) with the cached text of theirs, if it was made under the same fingerprint; the newest counts."""
    known = cache.filter(F.col("fingerprint") == fingerprint).groupBy("key").agg(F.max_by("text", "at").alias("cached"))
    return requests.join(known, "key", "left")


def results_and_kept(results: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """Translated paragraphs, and those kept as they were unless they are translated after all."""
    return results.withColumn("kept", F.lit(False)).unionByName(kept.join(results, key, "left_anti").withColumn("kept", F.lit(True)))


def reply_text(dialect: Column, body: Column) -> Column:
    """The text of a provider's JSON reply; parts that are thoughts don't count."""
    parts = F.from_json(F.coalesce(F.get_json_object(body, "$.content"), F.get_json_object(body, "$.candidates[0].content.parts"), F.lit("[]")), "array<struct<text:string,thought:boolean>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(dialect == "chat", F.get_json_object(body, "$.choices[0].message.content")).when(dialect.isin("messages", "generate"), joined)
