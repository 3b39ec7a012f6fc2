"""Sources and sinks of a library: manifests, event logs, settings, glossaries and files.

Rows that can't be read, or break the schema's rules, are set apart, and the rest goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.predicates import STAGES
from parchment.functions.text import cut_title, strip

MANIFEST = (
    "id string, title string, titleCustom boolean, originalFilename string, sourceSize bigint, sourceSha256 string, pages int, translator struct<providerId:string,model:string,label:string>, status string, stage string, progress double, "
    "failure struct<code:string,message:string,permanent:boolean>, attempts int, nextAttemptAt timestamp, stats struct<paragraphs:bigint,translatable:bigint,translated:bigint,kept:bigint,formulaRuns:bigint,opsRemoved:bigint,usage:struct<input:bigint,output:bigint>>, "
    "outputs struct<mono:struct<bytes:bigint>,dual:struct<bytes:bigint>,glossary:struct<bytes:bigint>>, createdAt timestamp, updatedAt timestamp, startedAt timestamp, completedAt timestamp"
)
EVENT = "seq bigint, at timestamp, stage string, level string, progress double, message string, detail string, current bigint, total bigint"
STATUSES, LEVELS = ("queued", "processing", "retrying", "completed", "failed", "cancelled"), ("info", "warning", "error")
MAX_FILE_BYTES = 500 << 20


def parse_json(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines with parsed: the object of each, or null where it isn't JSON or doesn't fit the schema."""
    typed = F.from_json(F.col(column), f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    return lines.withColumn("parsed", F.when(typed["__broken"].isNull(), typed))


def _rows(parsed: DataFrame, rules: Column) -> tuple[DataFrame, DataFrame]:
    good = parsed.filter(F.coalesce(F.col("parsed").isNotNull() & rules, F.lit(False)))
    return good, parsed.filter(~F.coalesce(F.col("parsed").isNotNull() & rules, F.lit(False)))


def parse_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines, and the lines that are none. Blank lines are neither."""
    filled = parse_json(lines.filter(strip(F.col(column)) != ""), EVENT, column)
    e = F.col("parsed")
    rules = (e["seq"] >= 1) & e["level"].isin(*LEVELS) & F.coalesce(e["progress"].between(0, 100), F.lit(True)) & e["stage"].isin(*STAGES, "done")
    good, bad = _rows(filled, rules)
    rest = [c for c in lines.columns if c != column]
    return good.select(*rest, "parsed.*").drop("__broken"), bad.drop("parsed")


def parse_manifests(files: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Manifests of whole JSON files, and the files that are none."""
    m = F.col("parsed")
    rules = m["id"].isNotNull() & m["status"].isin(*STATUSES) & m["progress"].between(0, 100)
    good, bad = _rows(parse_json(files, MANIFEST, column), rules)
    return good.select("parsed.*").drop("__broken"), bad.drop("parsed")


def read_manifests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return parse_manifests(spark.read.text(f"{folder}/*/manifest.json", wholetext=True))


def read_events(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events of all documents' logs; doc_id is the name of the log's folder."""
    lines = spark.read.text(f"{folder}/*/events.jsonl").withColumn("doc_id", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/events.jsonl$", 1))
    return parse_events(lines)


def settings_of(files: DataFrame, schema: str, defaults: dict, column: str = "value") -> DataFrame:
    """Settings files (whole JSON texts) with their values: what is missing has its default, and so has all of a file that is broken or null.

    broken tells which; a file that isn't there is no row, and whoever asks for it takes the defaults.
    """
    typed = parse_json(files, schema, column)
    rest = [c for c in files.columns if c != column]
    return typed.select(*rest, *[F.coalesce(F.col(f"parsed.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()], F.col("parsed").isNull().alias("broken"))


def read_settings(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """One row of settings; what is missing, or the whole file if it is broken, has its default."""
    files = parse_json(spark.read.text(path, wholetext=True), schema).agg(F.first("parsed", ignorenulls=True).alias("s"))
    return files.select(*[F.coalesce(F.col(f"s.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()])


def read_glossaries(spark: SparkSession, paths: list[str] | str, language: str) -> DataFrame:
    """name, ord, source, target of glossary CSVs: those entries that are for any language or the one asked for.

    Columns are found by their names. A file without source and target has no entries; names are those of the files. UTF-8, with or
    without a mark at its start; for files in another encoding see decode_csv().
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema("source string, target string, tgt_lng string").option("enforceSchema", False).csv(paths)
    rows = rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)).withColumn("ord", F.monotonically_increasing_id())
    return for_language(rows, language)


def for_language(entries: DataFrame, language: str) -> DataFrame:
    """Entries whose tgt_lng is blank or the language, whatever its case and whether "-" or "_" parts it."""
    plain = lambda c: F.replace(F.lower(strip(c)), F.lit("-"), F.lit("_"))
    wanted = plain(F.coalesce("tgt_lng", F.lit("")))
    kept = entries.filter((wanted == "") | (wanted == plain(F.lit(language))))
    return kept.withColumns({"source": F.coalesce("source", F.lit("")), "target": F.coalesce("target", F.lit(""))})


def decoded_text(raw: bytes | None) -> str | None:
    """One file's text as decode_csv has it."""
    try:
        return None if raw is None else raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


def decode_csv(files: DataFrame, column: str = "content") -> DataFrame:
    """Files with text: UTF-8 without the mark at its start, or else GB18030, in which bad bytes are replaced."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            yield got.append_column("text", pa.array(map(decoded_text, got.column(column).to_pylist()), pa.string()))

    return files.mapInArrow(decoded, files.withColumn("text", F.lit("")).schema)


def csv_field(value: Column) -> Column:
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def glossary_csv(entries: DataFrame, by: list[str]) -> DataFrame:
    """csv: each glossary as one text with a mark at its start, a header, and lines that end with CR LF."""
    line = F.concat_ws(",", csv_field(F.col("source")), csv_field(F.col("target")), csv_field(F.coalesce("tgt_lng", F.lit(""))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), line.alias("line")))), lambda r: F.concat(r["line"], F.lit("\r\n")))
    return entries.groupBy(*by).agg(F.concat(F.lit("\ufeffsource,target,tgt_lng\r\n"), F.array_join(rows, "")).alias("csv"))


def intake(files: DataFrame) -> DataFrame:
    """Files (path, length) with refused: why a file isn't taken in, or null."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumn("refused", F.when(F.col("length") <= 0, "empty").when(F.col("length") > MAX_FILE_BYTES, "too large").when(ext != ".pdf", "not a PDF"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "utf-8")


#: What may be wrong with a file, in the order in which it is looked at: code and what the user is told.
FAILURES = {"unreadable": "the file can't be read", "empty": "the file is empty", "too large": "the file is over 500 MB", "not a PDF": "the file is no PDF", "no header": "the file doesn't begin like a PDF"}


def ingest(files: DataFrame, title: Column | None = None) -> DataFrame:
    """Files (path, length, content) as documents or failures, in one pass: path, created and failure, of which one is null.

    created has id (SHA-256 of the content), title (what is asked for, or the file's name without its ending, 300 characters at most), filename and bytes. failure has
    code and message. No file stops the others; null content is unreadable, a null length is that of the content.
    """
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    known = intake(files.withColumn("length", F.coalesce("length", F.length("content").cast("long"))))
    code = F.when(F.col("content").isNull() & ~F.coalesce(F.col("refused") == "too large", F.lit(False)), "unreadable").when(F.col("refused").isNotNull(), F.col("refused")).when(~is_pdf(F.col("content")), "no header")
    failure = F.struct(F.col("code").alias("code"), F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])[F.col("code")].alias("message"))
    asked = F.lit(None).cast("string") if title is None else title
    made = F.struct(F.sha2("content", 256).alias("id"), cut_title(F.coalesce(F.nullif(strip(asked), F.lit("")), stem)).alias("title"), name.alias("filename"), F.col("length").alias("bytes"))
    return known.withColumn("code", code).select("path", F.when(F.col("code").isNull(), made).alias("created"), F.when(F.col("code").isNotNull(), failure).alias("failure"))


def read_pdfs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, length and content of files, for ingest(); one that is too large is not read. Spark's readers pass over files of no bytes."""
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).option("recursiveFileLookup", True).load(paths)
    return found.select("path", "length", F.when(F.col("length") <= MAX_FILE_BYTES, F.col("content")).alias("content"))


def append_numbered(events: DataFrame, path: str) -> None:
    """Append events to a log table; one writer at a time, as its numbers go on from what is there."""
    events.write.mode("append").parquet(path)
