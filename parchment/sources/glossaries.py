"""Glossary files as users keep them: CSV in Python's dialect, in one of two encodings, named by ids of which some are known."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parchment.operators import glossary
from parchment.sources.library import decoded_text, for_language

_ENTRY = pa.schema([("ord", pa.int32()), ("source", pa.string()), ("target", pa.string()), ("tgt_lng", pa.string())])
#: Entries that a task holds as Python objects at once, whatever the size of a file.
BATCH_ROWS = 4096


def read_rows(text: str) -> Iterator[list[str]]:
    """The rows of a CSV text. Quotes count at the start of a field only and are doubled inside; CR, LF and both end rows, blank rows are none."""
    csv.field_size_limit(1 << 31)
    return filter(None, csv.reader(io.StringIO(text, newline="")))


def parsed_rows(text: str) -> list[list[str]]:
    return list(read_rows(text))


def file_entries(raw: bytes | None) -> Iterator[tuple[int, str, str, str | None]] | None:
    """ord, source, target and tgt_lng of a file's rows one after another; None if it lacks the columns source and target."""
    rows = read_rows(decoded_text(raw) or "")
    header = next(rows, [])
    if "source" not in header or "target" not in header:
        return None
    at = [header.index(c) if c in header else -1 for c in ("source", "target", "tgt_lng")]
    return ((n, *(None if i < 0 else row[i] if i < len(row) else "" for i in at)) for n, row in enumerate(rows, 1))


def entries(files: DataFrame, by: list[str], language: str) -> tuple[DataFrame, DataFrame]:
    """The entries of glossary files (content: bytes), and the files that are none: those without the columns source and target.

    Entries have the columns of by, ord, source and target. What a row lacks is empty. Those for another language go; of entries of
    one file whose sources are the same but for case and blanks, the first one stays. A file without rows lacks both columns.
    """
    n = len(by)

    def parsed(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in batches:
                for i in range(got.num_rows):
                    own, found = got.slice(i, 1), file_entries(got.column(n)[i].as_py())
                    if not whole:
                        yield own.select(list(range(n))).slice(0, 0 if found else 1)
                        continue
                    for some in itertools.batched(found or (), BATCH_ROWS):
                        keys = [own.column(k).take(pa.array([0] * len(some))) for k in range(n)]
                        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(zip(*some, strict=True), _ENTRY.types, strict=True))], names=[*by, *_ENTRY.names])

        return run

    files = files.select(*by, "content")
    keyed = files.select(*by)
    found = files.mapInArrow(parsed(True), StructType([*keyed.schema.fields, *StructType.fromDDL("ord int, source string, target string, tgt_lng string").fields]))
    found = for_language(found, language).drop("tgt_lng")
    return glossary.dedupe(found, by).select(*by, "ord", "source", "target"), files.mapInArrow(parsed(False), keyed.schema)


def load(wanted: DataFrame, known: DataFrame, files: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the glossaries wanted (id and whatever goes along), by name; and those that can't be had, with why.

    A name is that of the known id, or else the id. files have id and content. One that is missing, or is no glossary, is passed over, so the
    rest of the work goes on. Columns of entries: those of wanted, name, ord, source and target.
    """
    good, bad = entries(files.dropDuplicates(["id"]), ["id"], language)
    named = wanted.join(known.select("id", "name").dropDuplicates(["id"]), "id", "left").withColumn("name", F.coalesce("name", F.col("id").cast("string")))
    there = named.join(files.select("id").distinct().withColumn("there", F.lit(True)), "id", "left").join(bad.withColumn("bad", F.lit(True)), "id", "left")
    failed = there.filter(F.col("there").isNull() | F.col("bad").isNotNull()).select(*wanted.columns, "name", F.when(F.col("there").isNull(), "missing").otherwise("format").alias("why"))
    return named.join(good, "id").select(*wanted.columns, "name", "ord", "source", "target"), failed


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """id and content of the CSV files of a folder; a file that vanishes meanwhile is missing, and so is one of no bytes, which Spark's readers pass over."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("ignoreMissingFiles", True).load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("id"), "content")
