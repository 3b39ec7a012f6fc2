"""Text functions: each takes and returns columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as whitespace, as the inside of a regular expression's class.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Rows that by_slices has as Python objects at once.
SLICE_ROWS = 64

#: Most code points of a file name's stem, a title and a quoted reply.
STEM_MAX, TITLE_MAX, SNIPPET_MAX = 120, 300, 400

# The default stem, and what is put after a stem for each kind of output.
DEFAULT_STEM = "文档"
OUTPUT_NAMES = {"mono": "-中文译文.pdf", "dual": "-双语对照.pdf", "bundle": "-完整文件.zip", "glossary": "-术语表.csv"}


def by_slices(work: Callable[..., list], kind: pa.DataType, *columns: pa.Array, rows: int = SLICE_ROWS) -> pa.Array:
    """work of the values of columns, a few rows at a time, so that no more than those are Python objects at once."""
    made = [pa.array(work(*(c.slice(at, rows).to_pylist() for c in columns)), kind) for at in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def sanitize_filename(name: Column) -> Column:
    """Control characters and those that file systems refuse become "_"; blanks and dots go from both ends."""
    bare = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1F\\/:*?"<>|]', "_"), r"^[\s.]+|[\s.]+$", "")
    return F.when(bare == "", DEFAULT_STEM).otherwise(F.left(bare, F.lit(STEM_MAX)))


def suggested_names(title: Column, original: Column) -> Column:
    stem = sanitize_filename(title)
    return F.struct(*[F.concat(stem, F.lit(end)).alias(kind) for kind, end in OUTPUT_NAMES.items()], original.alias("source"))


def split_keys(raw: Column) -> Column:
    return F.filter(F.split(raw, "[,，\\s;]+"), lambda k: k != "")


def mask_key(raw: Column) -> Column:
    """Bullets and the last four characters of the first key, if it has twelve or more; then how many there are."""
    keys = split_keys(raw)
    first = F.get(keys, F.lit(0))
    shown = F.concat(F.lit("•" * 8), F.when(F.length(first) >= 12, F.right(first, F.lit(4))).otherwise(""))
    return F.when(F.size(keys) == 0, "").when(F.size(keys) > 1, F.concat(shown, F.lit("（共 "), F.size(keys), F.lit(" 个）"))).otherwise(shown)


def normalize_source(term: Column) -> Column:
    return strip(collapse_spaces(F.lower(term)))


def ascii_fold(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collapse_punctuation(text: Column) -> Column:
    """Twenty or more full stops, commas and spaces in a row become one full stop."""
    return F.regexp_replace(text, "[. 。…，]{20,}", ".")


def clean_reply(reply: Column) -> Column:
    """The reply without blanks around it and without one leading block of reasoning."""
    return F.regexp_replace(strip(reply), r"^<think>[\s\S]+?</think>", "")


def strip_reasoning(reply: Column) -> Column:
    """The reply without one leading block of reasoning, <think> or <thinking> in any case, and the blanks around that."""
    return F.regexp_replace(reply, rf"(?i)^[{SPACE}]*<think(?:ing)?>[\s\S]*?</think(?:ing)?>[{SPACE}]*", "")


def clean_json_output(reply: Column) -> Column:
    """The reply without the tags and fences that models put around JSON: each is taken off once, in this order.

    Each step names the text before it once, or the expression would double with every step.
    """
    marks = [r"\A<json>", r"</json>\z", r"\A```json", r"\A```", r"```\z"]
    return strip(reduce(lambda text, m: F.regexp_replace(text, m, ""), marks, strip(reply)))


def redact(text: Column, keys: list[str]) -> Column:
    return reduce(lambda t, k: F.replace(t, F.lit(k), F.lit("[redacted]")), [k for k in keys if k], text)


def snippet(text: Column, limit: int = SNIPPET_MAX) -> Column:
    bare = strip(text)
    return F.when(F.length(bare) <= limit, bare).otherwise(F.concat(F.left(bare, F.lit(limit)), F.lit("…")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?i)\.pdf$", "")


def code_hex(code: Column, width: int) -> Column:
    """The code in hexadecimal, with two digits for each byte of its width."""
    return F.lpad(F.lower(F.hex(code)), 2 * width, "0")


#: Blanks of a PDF file, and a length that names the object holding it.
PDF_BLANK = r"[\x00\t\n\f\r ]"
LENGTH_REFERENCE = rf"/Length{PDF_BLANK}+(\d+){PDF_BLANK}+(\d+){PDF_BLANK}+R"


def inline_lengths(source: Column) -> Column:
    """The source of a PDF file with lengths in place of references to them, filled up with blanks, so that every byte stays where it is.

    source has a character for each byte (decode it as ISO-8859-1). Of objects of one number the last counts. A reference to no number, or to
    one that takes more room than the reference, stays.
    """
    found = F.regexp_extract_all(source, F.lit(rf"(?<![\d.])(\d+{PDF_BLANK}+\d+{PDF_BLANK}+obj{PDF_BLANK}*\d+){PDF_BLANK}*endobj"), F.lit(1))
    name = lambda x, pattern: F.concat_ws(" ", F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2))
    objects = F.array_sort(F.transform(found, lambda x, i: F.struct(name(x, rf"^(\d+){PDF_BLANK}+(\d+)").alias("name"), i.alias("at"), F.regexp_extract(x, r"(\d+)$", 1).alias("value"))))
    last = F.filter(objects, lambda o, i: ~F.coalesce(F.get(objects, i + 1)["name"] == o["name"], F.lit(False)))
    values = F.map_from_entries(F.transform(last, lambda o: F.struct(o["name"], o["value"])))
    parts = F.regexp_extract_all(source, F.lit(rf"(?s)({LENGTH_REFERENCE}|.+?(?={LENGTH_REFERENCE}|\z))"), F.lit(1))

    def patched(part: Column) -> Column:
        text = F.concat(F.lit("/Length "), F.try_element_at(values, name(part, f"^{LENGTH_REFERENCE}$")))
        return F.when(part.startswith("/Length") & (F.length(text) <= F.length(part)), F.rpad(text, F.length(part), " ")).otherwise(part)

    return F.when(source.contains("/Length"), F.array_join(F.transform(parts, patched), "")).otherwise(source)


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """$name by its value, and $$ by $; other text stays. Values are not looked through again."""
    parts = F.regexp_extract_all(template, F.lit(r"(\$\$|\$[_a-zA-Z][_a-zA-Z0-9]*|[^$]+|\$)"), F.lit(1))
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(f"${k}"), v)], F.lit("$$"), F.lit("$"))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def missing_names(template: Column, values: dict[str, Column]) -> Column:
    """The names that a template asks for and values doesn't have, each once, in order; a value that is null is there."""
    marks = F.regexp_extract_all(F.replace(template, F.lit("$$"), F.lit("")), F.lit(r"\$([_a-zA-Z][_a-zA-Z0-9]*)"), F.lit(1))
    return F.array_distinct(F.filter(marks, lambda n: ~n.isin(*values) if values else F.lit(True)))


def substitute_all(template: Column, values: dict[str, Column]) -> Column:
    """substitute(), which fails on a name that has no value."""
    missing = missing_names(template, values)
    return F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing template value "), F.get(missing, F.lit(0))))).otherwise(substitute(template, values))


#: Fixed value: the line that every prompt ends with.
STRICT = "Follow all rules strictly."


def role_block(custom: Column, language: str) -> Column:
    """Who the model is asked to be: the user's words, with the line that every prompt has, or those that stand for none."""
    own = strip(custom)
    default = f"You are a professional {language} native translator who needs to fluently translate text into {language}.\n\n{STRICT}"
    return F.when(F.coalesce(custom, F.lit("")) == "", default).when(own.contains(STRICT), own).otherwise(F.concat(own, F.lit(f"\n{STRICT}")))


def cut_title(text: Column) -> Column:
    return F.left(text, F.lit(TITLE_MAX))


def fill_braces(template: Column, values: dict[str, Column]) -> Column:
    """{name} by its value, and {{ and }} by one brace."""
    parts = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{[_a-zA-Z0-9]+\}|[^{}]+|[{}])"), F.lit(1))
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(f"{{{k}}}"), v)], F.lit("{{"), F.lit("{"), F.lit("}}"), F.lit("}"))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def document_id(at: Column, hex6: Column) -> Column:
    """Ids that sort by time: UTC date and time, then six hexadecimal digits."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.left(F.rpad(hex6, 6, "0"), F.lit(6)))


def hit_ratio(text: Column, pattern: str) -> Column:
    """Which share of the text's code points lies in matches of the pattern, each match counting once; 0 for none."""
    n = F.regexp_count(text, F.lit(pattern))
    rest = F.length(F.regexp_replace(text, pattern, ""))
    return F.when(n + rest == 0, 0.0).otherwise(n / (n + rest))
