"""Placeholders in texts, names of glyphs, and requests to providers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import by_slices, collapse_spaces

FORMULA = r"\{\s*v\s*\d+\s*\}"

# Fixed value: frequent characters that compatibility composition leaves alone, and which nothing before them is composed with, as the inside of a regular expression's class.
STABLE = (
    r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{131}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{2AF}\x{38E}-\x{3A1}\x{3A3}-\x{3CF}\x{3FA}-\x{482}\x{48A}-\x{52F}\x{531}-\x{556}\x{5D0}-\x{5EA}"
    r"\x{1E00}-\x{1E99}\x{1E9C}-\x{1F15}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20AC}\x{2190}-\x{222B}\x{2231}-\x{2328}\x{2500}-\x{27FF}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A0}-\x{30FE}\x{3400}-\x{A48C}\x{AC00}-\x{D7A3}\x{1F300}-\x{1F6D7}\x{20000}-\x{2A6DF}"
)


def nfkc(text: Column) -> Column:
    """Compatibility composition: no built-in function has it, so it runs over Arrow batches, a few rows at a time.

    Only what may change is sent: runs of characters that aren't STABLE, each with the one before it. A STABLE character begins a part
    of the text that is composed by itself. Texts of ASCII alone are not looked through.
    """

    @F.arrow_udf("array<string>")
    def composed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for got in batches:
            yield by_slices(lambda rows: [r if r is None else [normalize("NFKC", t) for t in r] for r in rows], pa.list_(pa.string()), got)

    run = rf"(?s).?[\x{{80}}-\x{{10FFFF}}&&[^{STABLE}]]+"
    runs = composed(F.when(F.octet_length(text) > F.char_length(text), F.regexp_extract_all(text, F.lit(run), F.lit(0))))
    whole = F.array_join(F.zip_with(F.split(text, run, -1), runs, lambda between, t: F.concat(between, F.coalesce(t, F.lit("")))), "")
    return F.when(F.size(runs) > 0, whole).otherwise(text)


def normalize_spaces(text: Column) -> Column:
    return collapse_spaces(nfkc(text))


def placeholders(text: Column, pattern: str = FORMULA) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def without_foreign(text: Column, allowed: Column, pattern: str = FORMULA) -> Column:
    """The text without placeholders that are not among the allowed ones."""
    parts = F.regexp_extract_all(text, F.lit(rf"({pattern}|[^{{]+|\{{)"), F.lit(1))
    return F.array_join(F.filter(parts, lambda p: ~p.rlike(f"^{pattern}$") | F.array_contains(allowed, p)), "")


def lost(text: Column, allowed: Column, pattern: str = FORMULA) -> Column:
    """The allowed placeholders that the text lacks."""
    return F.array_except(allowed, placeholders(text, pattern))


def glyph_text(name: Column, known: Column) -> Column:
    """The text of a glyph's name: known ones, "uni" and four hexadecimal digits for each character, "u" and four to six.

    What follows a dot doesn't count, and parts between underscores are names of their own. null if a part has no meaning.
    """
    parts = F.split(F.element_at(F.split(name, r"\."), 1), "_")
    hex4 = lambda p: F.decode(F.unhex(F.substring(p, 4, 400)), "UTF-16BE")
    hex6 = lambda p: F.decode(F.unhex(F.lpad(F.substring(p, 2, 6), 8, "0")), "UTF-32")
    one = lambda p: F.coalesce(F.try_element_at(known, p), F.when(p.rlike("^uni([0-9A-Fa-f]{4})+$"), hex4(p)).when(p.rlike("^u[0-9A-Fa-f]{4,6}$"), hex6(p)))
    texts = F.transform(parts, one)
    return F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, ""))


def chat_url(kind: Column, base: Column, model: Column) -> Column:
    bare = F.regexp_replace(base, "/+$", "")
    messages = F.when(bare.endswith("/v1"), F.concat(bare, F.lit("/messages"))).otherwise(F.concat(bare, F.lit("/v1/messages")))
    root = F.when(bare.endswith("/v1beta"), bare).otherwise(F.concat(bare, F.lit("/v1beta")))
    generate = F.concat(root, F.lit("/models/"), F.regexp_replace(model, "^models/", ""), F.lit(":generateContent"))
    return F.when(kind.isin("openai", "azure"), F.concat(bare, F.lit("/chat/completions"))).when(kind == "anthropic", messages).otherwise(generate)


def key_optional(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin("localhost", "127.0.0.1", "[::1]", "::1"), F.lit(False))


def merged_settings(base: Column, extra: Column) -> Column:
    """One level of settings (maps) over another: what extra has counts, also where it is null."""
    return F.map_zip_with(base, extra, lambda k, a, b: F.when(F.map_contains_key(extra, k), b).otherwise(a))


def merged_json(base: Column, extra: Column) -> Column:
    """Settings as JSON objects, merged level by level: objects merge, all else of extra (null and lists too) replaces what base has.

    A text that is no object counts as {} in base, and changes nothing in extra.
    """

    def merged(a: dict, b: dict) -> dict:
        return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    def read(text: str | None) -> dict:
        try:
            return got if isinstance(got := json.loads(text or ""), dict) else {}
        except ValueError:
            return {}

    @F.arrow_udf("string")
    def over(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([json.dumps(merged(read(x), read(y)), ensure_ascii=False) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return over(base, extra)


def request_body(kind: Column, model: Column, system: Column, user: Column) -> Column:
    """The JSON of a request in the dialect of a provider."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.to_json(F.struct(model.alias("model"), F.array(message("system", system), message("user", user)).alias("messages")))
    messages = F.to_json(F.struct(model.alias("model"), system.alias("system"), F.array(message("user", user)).alias("messages")))
    part = lambda t: F.array(F.struct(t.alias("text")))
    generate = F.to_json(F.struct(F.struct(part(system).alias("parts")).alias("systemInstruction"), F.array(F.struct(F.lit("user").alias("role"), part(user).alias("parts"))).alias("contents")))
    return F.when(kind.isin("openai", "azure"), chat).when(kind == "anthropic", messages).otherwise(generate)


def spaced_text(chars: Column) -> Column:
    """The text of characters (text, x0, x1, y0, y1) with a space at wide gaps and at line ends.

    Wide is a gap of at least the second smallest distinct one over 1 (the only one, or 1, if there aren't two). A line
    ends before a character below the one before it, or far to the left of it. A space is never followed by another.
    """
    at = lambda i: F.element_at(chars, i)
    pairs = F.when(F.size(chars) > 1, F.sequence(F.lit(1), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
    gaps = F.array_sort(F.array_distinct(F.filter(F.transform(pairs, lambda i: at(i + 1)["x0"] - at(i)["x1"]), lambda g: g > 1)))
    wide = F.when(F.size(gaps) == 0, 1.0).when(F.size(gaps) == 1, F.get(gaps, F.lit(0))).otherwise(F.get(gaps, F.lit(1)))
    broad = lambda a, b: F.greatest(b["x1"] - b["x0"], a["x1"] - a["x0"])
    breaks = lambda a, b: (b["y1"] < a["y0"]) | (b["x1"] < a["x0"] - broad(a, b) * 10)
    ended = lambda i: (at(i)["text"] != " ") & ((at(i + 1)["x0"] - at(i)["x1"] >= wide) | breaks(at(i), at(i + 1)))
    parts = F.transform(pairs, lambda i: F.when(ended(i), F.concat(at(i)["text"], F.lit(" "))).otherwise(at(i)["text"]))
    return F.btrim(collapse_spaces(F.concat(F.array_join(parts, ""), F.when(F.size(chars) > 0, at(-1)["text"]).otherwise(""))))
