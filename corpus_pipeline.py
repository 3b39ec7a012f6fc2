"""From raw documents to packed sequences, in stages that each write what they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from parchment.llm.common import inside, join_groups, packed, table, unpacked, without, write_table
from parchment.llm.queries import HARMS, harms, held_out, words


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in one struct, so that no name of an operator's columns touches them."""
    return docs.select("doc_id", "text", F.struct(*without(docs, "text")).alias("row"))


def together(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs, in their order, of what an operator made of apart(docs); new ones take the place of theirs."""
    return found.select(*[new.get(c.lower(), F.col("text") if c.lower() == "text" else inside(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labelled ones of the given tables, finds toxic go. Null texts count as empty."""
    raw = table(spark, sf_dir, "documents")
    chain = toxicity.train_toxicity(raw, harms(table(spark, sf_dir, "labels")), HARMS, usable=~held_out())
    return together(chain.score(apart(docs)).filter(~F.col("toxic")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, the documents stay, also those that are then empty; n_chars follows the text."""
    return together(line_dedup.line_dedup(apart(docs)), docs, n_chars=F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: the one that jaccard_join keeps. Documents without words are no class and stay."""
    found = jaccard.jaccard_join(docs.select("doc_id", "text"))
    key = lambda text: [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), text.alias("text")]
    found = found.groupBy(*key(F.col("text_hash"))).agg(F.bool_or("kept").alias("one"), F.bool_and("kept").alias("all"), F.count("*").alias("n"))
    found = write_table(found.filter(~F.col("all")).drop("all"), "near-duplicates")
    met = join_groups(docs.select(packed(docs), *key(F.xxhash64("text"))), found, ["none", "key", "text"], "n", F.monotonically_increasing_id(), shuffle=True)
    # rows that repeat both id and text, of which one stays
    one = met.filter("one").groupBy("none", "key", "text").agg(F.first("row").alias("row"))
    rest = met.filter(F.col("one").isNull()).select("row").unionByName(one.select("row"))
    return rest.select(*unpacked(rest))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in windows of the benchmark go. Texts without words stay."""
    found = decontaminate.find_contamination(apart(docs), table(spark, sf_dir, "benchmark"))
    return together(found.filter(~F.col("contaminated")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go; a text, also an empty or null one, has one token more to end it. Repeated rows are packed each."""
    return packing.pack(docs.select("doc_id", "text"), words())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the similarity join and the packing have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents: an empty table gives none, and columns besides those of documents pass through."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
