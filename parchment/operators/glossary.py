"""Glossaries: term pairs in order, deduplicated, found in texts, and mined from replies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import ascii_fold, collapse_spaces, normalize_source
from parchment.sources.scratch import scratch_path, written

_TERMS = "array<struct<ord:bigint,source:string,target:string>>"
_TERMS_ARROW = pa.list_(pa.struct([("ord", pa.int64()), ("source", pa.string()), ("target", pa.string())]))
_automata: dict[str, ahocorasick.Automaton] = {}


def dedupe(entries: DataFrame, by: list[str], source: str = "source", order: str = "ord") -> DataFrame:
    """The first entry, in order, of each source, whatever its case and blanks."""
    first = Window.partitionBy(*by, normalize_source(F.col(source))).orderBy(order)
    return entries.withColumn("__at", F.row_number().over(first)).filter("__at = 1").drop("__at")


def _finder(block: Broadcast):
    name = uuid.uuid4().hex

    @F.arrow_udf(_TERMS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _automata:  # built once in each Python worker; one at a time
            _automata.clear()
            made = ahocorasick.Automaton()
            for term in block.value:
                made.get(term[0], None) or made.add_word(term[0], [])
                made.get(term[0]).append(term[1:])
            if len(made):
                made.make_automaton()
            _automata[name] = made
        automaton = _automata[name]
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                terms = {t for _, own in automaton.iter(text) for t in own} if text and len(automaton) else ()
                out.append([dict(zip(("ord", "source", "target"), t, strict=True)) for t in sorted(terms, key=lambda t: t[:2])])
            yield pa.array(out, _TERMS_ARROW)

    return found


def matches(texts: DataFrame, entries: DataFrame, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """texts with terms: the entries (ord, source, target) whose source is somewhere in the text, in their order.

    Blanks in a row count as one space, and A to Z match a to z. Entries without a source are never found. One automaton of all terms reads each text once,
    where it lies. The glossary is broadcast in blocks of about block_bytes, whose sizes are checked; a larger one
    takes as many scans, and the terms they find meet at a number that each text has.
    """
    spark = texts.sparkSession
    folded = ascii_fold(F.col("source"))
    kept = entries.filter(F.col("source") != "").select(folded.alias("folded"), F.col("ord").cast("long").alias("ord"), "source", "target", (F.octet_length("source") * 2 + F.coalesce(F.octet_length("target"), F.lit(0)) + 16).alias("bytes"))
    kept = written(kept.distinct(), "glossary")
    total, largest = kept.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    blocks = max(1, -(-total // block_bytes))
    of = lambda n: F.pmod(F.xxhash64("ord", "source", "target"), F.lit(n)).cast("int")
    while blocks > 1 and kept.groupBy(of(blocks)).agg(F.sum("bytes").alias("n")).agg(F.max("n")).first()[0] > max(2 * block_bytes, 4 * largest):
        blocks *= 2
    hay = ascii_fold(collapse_spaces(F.col(text_col)))

    def find(k: int) -> Column:
        held = kept.filter(of(blocks) == k).select("folded", "ord", "source", "target").collect()
        return _finder(spark.sparkContext.broadcast([tuple(r) for r in held]))(hay)

    if blocks == 1:
        return texts.withColumn("terms", find(0))
    numbered = written(texts.select(F.struct("*").alias("row"), F.col(text_col), F.monotonically_increasing_id().alias("at")), "texts")
    path = scratch_path(spark, "found")
    for k in range(blocks):
        found = numbered.select("at", find(k).alias("terms")).filter(F.size("terms") > 0)
        found.write.mode("append").parquet(path)
    met = spark.read.schema(found.schema).parquet(path).groupBy("at").agg(F.array_sort(F.flatten(F.collect_list("terms"))).alias("terms"))
    return numbered.join(met, "at", "left").select("row.*", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))


def most_frequent(pairs: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """For each source its most frequent target; of equally frequent ones that seen first."""
    counted = pairs.groupBy(source, target).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(source).agg(F.max_by(target, F.struct(F.col("__n"), -F.col("__first"))).alias(target), F.max("__n").alias("votes"))


def last_named(entries: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """Of glossaries of one name the last counts, in the place of the first."""
    return entries.groupBy(*by, name).agg(F.max_by(F.struct("*"), order).alias("__e"), F.min(order).alias("place")).select(*by, name, "place", "__e.target")


def in_use(user: DataFrame, mined: DataFrame, mine: bool) -> DataFrame:
    """The mined glossary alone if terms are mined and there are any, else the user's and then the mined one.

    Whether there are any is one row that is joined in; no job runs while the plan is built.
    """
    if not mine:
        return user.unionByName(mined)
    found = F.broadcast(mined.limit(1).select(F.lit(1).alias("__any")))
    return user.withColumn("__any", F.lit(1)).join(found, "__any", "left_anti").drop("__any").unionByName(mined)


def table_text(entries: DataFrame, by: list[str]) -> DataFrame:
    """A glossary as the lines of a table, sorted by source and target."""
    rows = F.array_sort(F.collect_list(F.struct("source", "target")))
    line = lambda e: F.concat(F.lit("| "), e["source"], F.lit(" | "), e["target"], F.lit(" |"))
    return entries.groupBy(*by).agg(F.array_join(F.transform(rows, line), "\n").alias("lines"))
