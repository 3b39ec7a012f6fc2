"""What the codes of a font stand for, read from the text of its map."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.tokens import glyph_text

_HEX, _INT = r"<[0-9A-Fa-f\s]*>", r"[-+]?\d+"
_ONE = f"(?:{_HEX}|{_INT})"
_PAIR = rf"({_ONE})\s*({_ONE})"
_TRIPLE = rf"({_ONE})\s*({_ONE})\s*({_ONE}|\[[^\]]*\])"
_BLOCK = r"(?s)begin(bfchar|bfrange|cidchar|cidrange)\b.*?end\1"
NBSP = "\u00a0"
_ITEM = rf"({_HEX}|/[^\s<>\[\]/()%{{}}]+|{_INT})"
_MARK = re.compile(r"%[^\r\n]*|\(")
_IN_STRING = re.compile(r"\\([0-7]{1,3}|\r\n|[\s\S])|([()])")
# What a letter after a backslash stands for.
_ESCAPES = {"n": 10, "r": 13, "t": 9, "b": 8, "f": 12}


def bytes_of_string(text: str, at: int) -> tuple[bytes, int]:
    """The bytes of a string in brackets that begins before at, and where it ends; one that is never closed goes on to the end.

    Brackets inside come in pairs or after a backslash, which also stands before octal numbers and line ends that don't count.
    """
    out, depth = bytearray(), 1
    while depth:
        m = _IN_STRING.search(text, at)
        out += bytes(c & 255 for c in map(ord, text[at : m.start() if m else len(text)]))
        if m is None:
            return bytes(out), len(text)
        at, said = m.end(), m[1]
        if said is None:
            depth += 1 if m[2] == "(" else -1
            out += m[2].encode() if depth else b""
        elif said[0] in "01234567":
            out.append(int(said, 8) & 255)
        elif said[0] not in "\r\n":
            out.append(_ESCAPES.get(said, ord(said) & 255))
    return bytes(out), at


def strings_as_hex(text: str) -> str:
    """The text without comments, and with <...> for each string in brackets."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "(":
            said, at = bytes_of_string(text, at)
            out.append(f"<{said.hex()}>")
        else:
            out.append(" ")
    return "".join([*out, text[at:]])


def _strings_as_hex(source: Column) -> Column:
    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else strings_as_hex(t) for t in texts.to_pylist()], pa.string())

    return read(source)


def hex_digits(token: Column) -> Column:
    """The digits of <...>, two for each byte; a missing last one is 0."""
    digits = F.upper(F.regexp_replace(token, r"[<>\s]", ""))
    return F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)


def utf16_text(digits: Column) -> Column:
    """The text of UTF-16BE bytes in hexadecimal; surrogates without their other half and incomplete ends are left out."""
    units = F.regexp_extract_all(digits, F.lit("(D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2}|[0-9A-F]{4}|[0-9A-F]+)"), F.lit(1))
    whole = F.filter(units, lambda u: (F.length(u) == 8) | ((F.length(u) == 4) & ~u.rlike("^D[89A-F]")))
    return F.decode(F.unhex(F.array_join(whole, "")), "UTF-16BE")


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _plus(digits: Column, k: Column) -> Column:
    """k added to the last four bytes."""
    wide = F.least(F.length(digits), F.lit(8))
    high = F.left(digits, F.length(digits) - wide)
    return F.concat(high, F.right(F.lpad(F.hex(_number(F.right(digits, wide)) + k), 16, "0"), wide))


def unicode_maps(fonts: DataFrame, by: list[str], source: str, names: dict[str, str] | None = None) -> DataFrame:
    """by, cid and text: what each code of a font's ToUnicode map stands for.

    The map has blocks of bfchar (code, text), bfrange (first code, last code, and the first one's text or a list of texts), cidchar (number, text) and
    cidrange (first text, last text, first number). Of several texts for a code the last counts, but a no-break space does not replace
    a blank. Ranges whose ends differ in bytes, and entries of other kinds, say nothing; so does what comes after endcmap. Texts are
    UTF-16BE, hexadecimal or strings in brackets. Lists may also have numbers of characters and glyphs' names: those of names (none unless they
    are given) and those that tell their characters, see glyph_text; one of another name says nothing. Every range is exploded, so a font's rows are spread as any others are.
    """
    bare = F.when(F.col(source).contains("("), _strings_as_hex(F.col(source))).otherwise(F.regexp_replace(source, r"%[^\r\n]*", " "))
    plain = F.regexp_replace(bare, r"(?s)\bendcmap\b.*?(\bbegincmap\b|\z)", " ")
    blocks = fonts.select(*by, F.posexplode(F.regexp_extract_all(plain, F.lit(_BLOCK), F.lit(0))).alias("block", "body"))
    kind, body = F.regexp_extract("body", "^begin([a-z]+)", 1), F.regexp_replace("body", "^begin[a-z]+|end[a-z]+$", "")
    entries = F.when(kind.endswith("char"), F.regexp_extract_all(body, F.lit(_PAIR), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(_TRIPLE), F.lit(0)))
    rows = blocks.select(*by, "block", kind.alias("kind"), F.posexplode(entries).alias("entry", "e"))
    part = lambda i: F.when(F.col("kind").endswith("char"), F.regexp_extract("e", _PAIR, min(i, 2))).otherwise(F.regexp_extract("e", _TRIPLE, i))
    rows = rows.select(*by, "block", "entry", "kind", *[part(i).alias(f"t{i}") for i in (1, 2, 3)])
    rows = rows.select("*", *[F.when(F.col(f"t{i}").startswith("<"), hex_digits(F.col(f"t{i}"))).alias(f"h{i}") for i in (1, 2, 3)], *[F.col(f"t{i}").try_cast("long").alias(f"n{i}") for i in (1, 3)])

    nothing = F.lit(None).cast("string")
    item = lambda cid, digits, said=nothing: F.struct(cid.alias("cid"), digits.alias("digits"), said.alias("said"))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    sign = lambda t: F.when((t.try_cast("long") >= 0) & (t.try_cast("long") <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(t.try_cast("long")), 8, "0")), "UTF-32"))
    spoken = lambda t: F.when(t.startswith("/"), glyph_text(F.substring(t, 2, 1 << 20), known)).when(~t.startswith("<"), sign(t))
    tail = lambda h: F.right(h, F.least(F.length(h), F.lit(8)))
    steps = lambda first, last: F.when(last >= first, F.sequence(F.lit(0).cast("long"), last - first))
    first, last = _number(F.col("h1")), _number(F.col("h2"))
    alike = (F.length("h1") == F.length("h2")) & (F.length("h1") > 0)
    texts = F.transform(F.regexp_extract_all("t3", F.lit(_ITEM), F.lit(1)), lambda t, k: item(first + k, F.when(t.startswith("<"), hex_digits(t)), spoken(t)))
    same_high = F.left("h1", F.length("h1") - F.length(tail(F.col("h1")))) == F.left("h2", F.length("h2") - F.length(tail(F.col("h2"))))
    items = (
        F.when((F.col("kind") == "bfchar") & F.col("h2").isNotNull(), F.array(item(first, F.col("h2"))))
        .when((F.col("kind") == "cidchar") & F.col("h2").isNotNull(), F.array(item(F.col("n1"), F.col("h2"))))
        .when((F.col("kind") == "bfrange") & alike & F.col("t3").startswith("["), F.filter(texts, lambda x: x["cid"] <= last))
        .when((F.col("kind") == "bfrange") & alike & F.col("h3").isNotNull(), F.transform(steps(first, last), lambda k: item(first + k, _plus(F.col("h3"), k))))
        .when((F.col("kind") == "cidrange") & alike & same_high, F.transform(steps(_number(tail(F.col("h1"))), _number(tail(F.col("h2")))), lambda k: item(F.col("n3") + k, _plus(F.col("h1"), k))))
    )
    said = rows.select(*by, "block", "entry", F.posexplode(items).alias("k", "i")).select(*by, F.struct("block", "entry", "k").alias("at"), "i.cid", F.coalesce("i.said", utf16_text(F.col("i.digits"))).alias("said")).filter("cid IS NOT NULL AND said IS NOT NULL")
    final = said.groupBy(*by, "cid").agg(F.max_by("said", "at").alias("last"), F.max_by("said", F.when(F.col("said") != NBSP, F.col("at"))).alias("other"))
    return final.select(*by, "cid", F.when((F.col("last") == NBSP) & (F.col("other") == " "), " ").otherwise(F.col("last")).alias("text"))
