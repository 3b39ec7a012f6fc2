"""Marks that stand for formulas and styled text while a paragraph is translated, and what a reply makes of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.predicates import is_numeric, is_placeholder_only
from parchment.functions.text import SPACE, by_slices

#: With more marks than this, styled text goes without.
MOST_MARKS = 40

# The marks' shapes; a number stands where the dots are.
FORMULA_MARK = r"\{\s*v\s*([0-9]+)\s*\}"
OPEN_MARK = r"<\s*style\s*id\s*=\s*'\s*([0-9]+)\s*'\s*>"
CLOSE_MARK = r"<\s*/\s*style\s*>"
CLOSE = "</style>"

_MARKS = "array<struct<kind:string,id:int,part:int,text:string>>"
_ANY = re.compile(f"{FORMULA_MARK}|{OPEN_MARK}|{CLOSE_MARK}", re.IGNORECASE)
_LINE_END = re.compile(r"[\n\r\u2028\u2029]")


def mark(parts: list[dict], text: str | None, styled: bool = True) -> dict:
    """The text and marks of one paragraph's parts, in one pass; with more than MOST_MARKS, once more without styles."""
    begins = {kind: int(m[1]) if (m := re.match(shape, text or "", re.IGNORECASE)) else -1 for kind, shape in (("formula", FORMULA_MARK), ("run", OPEN_MARK))}
    out, marks, following = [], [], 1
    for at, p in enumerate(parts):
        formula = p["kind"] == "formula"
        if not formula and (p["plain"] or not styled):
            out.append(p["text"] or "")
            continue
        kind = "formula" if formula else "run"
        number = following + (following == begins[kind])
        out.append(f"{{v{number}}}" if formula else f"<style id='{number}'>{p['text'] or ''}{CLOSE}")
        marks.append({"kind": kind, "id": number, "part": at, "text": p["text"]})
        following = number + (1 if formula else 2)
    return mark(parts, text, styled=False) if styled and len(marks) > MOST_MARKS else {"text": "".join(out), "marks": marks}


def same_style(font: Column, size: Column, gstate: Column, base_font: Column, base_size: Column, base_gstate: Column) -> Column:
    """Whether a run has its paragraph's style: font, size (to 0.02) and graphics state."""
    return (font == base_font) & (F.abs(size - base_size) < 0.02) & gstate.eqNullSafe(base_gstate)


def plain_style(font: Column, size: Column, gstate: Column, base_font: Column, base_size: Column, base_gstate: Column, mapped: Column | None = None, base_mapped: Column | None = None) -> Column:
    """Whether a run counts as plain beside its paragraph's style, and needs no mark.

    It does if it has that style, or has it but for a size of 0.7 to 1.3 times as much, or but for the font where both fonts are mapped to one that
    is there. Null styles aren't plain.
    """
    ratio = F.abs(size / F.nullif(base_size.cast("double"), F.lit(0.0)))
    same_state = gstate.eqNullSafe(base_gstate)
    but_size = (font == base_font) & (ratio > 0.7) & (ratio < 1.3) & same_state
    but_font = F.lit(False) if mapped is None else (F.abs(size - base_size) < 0.02) & same_state & (F.coalesce(mapped, F.lit("")) != "") & (mapped == base_mapped)
    return F.coalesce(same_style(font, size, gstate, base_font, base_size, base_gstate), F.lit(False)) | F.coalesce(but_size, F.lit(False)) | F.coalesce(but_font, F.lit(False))


def marked_text(parts: Column, text: Column) -> Column:
    """What is sent of a paragraph: text, with marks in it, and marks (kind, id, part: its index, text: what it stands for).

    parts (kind "formula" or "run", text, plain: whether a run has the paragraph's own style, see plain_style) make up the paragraph, text is all of it. Formulas take one number,
    styled runs two. A number that the paragraph's text itself begins with is passed over. Where there would be more than
    MOST_MARKS, only formulas are marked. null for paragraphs that aren't sent: those without parts, with a single formula, and those of a number or bare placeholders.
    Time is in proportion to the parts, and nothing is sent to Python; mark() tells the rules in one pass.
    """
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    begin = lambda shape: F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), "(?iu)^" + shape.replace(r"\s", f"[{SPACE}]"), 1).try_cast("int"), F.lit(-1))
    begins = F.struct(begin(FORMULA_MARK).alias("formula"), begin(OPEN_MARK).alias("run"))
    said = lambda p: F.coalesce(p["text"], F.lit(""))

    def numbers(found: Column, first: Column) -> Column:
        # with styles there are few marks, which a fold numbers; formulas alone take one number each
        def following(s: Column, m: Column) -> Column:
            number = s["next"] + F.when(s["next"] == F.when(m["formula"], first["formula"]).otherwise(first["run"]), 1).otherwise(0)
            return F.struct((number + F.when(m["formula"], 1).otherwise(2)).alias("next"), F.array_append(s["ids"], number).alias("ids"))

        folded = F.aggregate(found, F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids")), following, lambda s: s["ids"])
        return F.when(F.size(found) <= MOST_MARKS, folded).otherwise(F.transform(found, lambda m, k: k + 1 + F.when((first["formula"] > 0) & (k + 1 >= first["formula"]), 1).otherwise(0)))

    def mended(found: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(found, k - 1)["part"]).otherwise(-1)
        between = lambda after, upto: F.array_join(F.transform(F.slice(parts, after + 2, upto - after - 1), said), "")
        shown = lambda m: F.when(m["kind"] == "formula", F.concat(F.lit("{v"), m["id"], F.lit("}"))).otherwise(F.concat(F.lit("<style id='"), m["id"], F.lit("'>"), said(m), F.lit(CLOSE)))
        pieces = F.transform(found, lambda m, k: F.concat(between(before(k), m["part"]), shown(m)))
        whole = F.concat(F.array_join(pieces, ""), between(before(F.size(found)), F.size(parts)))
        return F.struct(whole.alias("text"), found.alias("marks"))

    every = F.transform(parts, lambda p, i: F.struct(i.alias("part"), F.coalesce(p["kind"] == "formula", F.lit(False)).alias("formula"), p["text"].alias("text"), F.coalesce(p["plain"], F.lit(False)).alias("plain")))
    styled = F.filter(every, lambda p: p["formula"] | ~p["plain"])
    used = once(styled, lambda some: F.when(F.size(some) <= MOST_MARKS, some).otherwise(F.filter(some, lambda p: p["formula"])))
    kind = lambda m: F.when(m["formula"], "formula").otherwise("run").alias("kind")
    found = once(F.struct(used.alias("used"), begins.alias("begins")), lambda v: once(F.struct(v["used"].alias("used"), numbers(v["used"], v["begins"]).alias("ids")), lambda u: F.transform(u["used"], lambda m, k: F.struct(kind(m), F.get(u["ids"], k).alias("id"), m["part"].alias("part"), m["text"].alias("text")))))
    marked = once(found, mended).cast(f"struct<text:string,marks:{_MARKS}>")

    sent = ~F.coalesce(is_numeric(text), F.lit(False)) & ~F.coalesce(is_placeholder_only(text), F.lit(False)) & (F.size(parts) > 0)
    whole = F.struct(text.alias("text"), F.array().cast(_MARKS).alias("marks"))
    one = F.when(F.get(parts, F.lit(0))["kind"] != "formula", whole)
    return F.when(sent, F.when(F.size(parts) == 1, one).otherwise(marked))


def _known(marks: list[dict]) -> tuple[dict[str, dict], dict[str, dict]]:
    return {str(m["id"]): m for m in marks if m["kind"] == "formula"}, {str(m["id"]): m for m in marks if m["kind"] == "run"}


def split_reply(reply: str, marks: list[dict], own: set[str]) -> list[dict]:
    """A reply as pieces: formulas and runs by their index (part), runs that came back unchanged as "original", and text.

    Marks are read one after another. A formula's mark is that formula; a run's mark holds up to the first closing one on the same
    line. All others leave the text: marks that were sent, and marks never sent unless the source (own) has them just so.
    """
    formulas, runs = _known(marks)
    if not marks:
        return [{"kind": "text", "text": reply, "part": None}]
    sent = {f"{{v{n}}}" for n in formulas} | {f"<style id='{n}'>" for n in runs} | ({CLOSE} if runs else set())

    def bare(text: str) -> str:
        def keep(m: re.Match) -> str:
            known = m[1] in formulas if m[1] else m[2] in runs if m[2] else bool(runs)
            return m[0] if not known and m[0] in own | sent else ""

        return _ANY.sub(keep, text)

    pieces, done, found = [], 0, list(_ANY.finditer(reply))
    for k, m in enumerate(found):
        if m.start() < done:
            continue
        if m[1] in formulas:
            piece, end = {"kind": "formula", "text": None, "part": formulas[m[1]]["part"]}, m.end()
        elif m[2] in runs:
            close = next((c for c in found[k + 1 :] if not c[1] and not c[2]), None)
            if close is None or _LINE_END.search(reply, m.end(), close.start()):
                continue
            inner, run, end = reply[m.end() : close.start()], runs[m[2]], close.end()
            same = inner.replace(" ", "") == (run["text"] or "").replace(" ", "")
            piece = {"kind": "original" if same else "run", "text": None if same else bare(inner), "part": run["part"]}
        else:
            continue
        if m.start() > done:
            pieces.append({"kind": "text", "text": bare(reply[done : m.start()]), "part": None})
        pieces.append(piece)
        done = end
    return pieces + ([{"kind": "text", "text": bare(reply[done:]), "part": None}] if done < len(reply) else [])


def reply_pieces(reply: Column, marks: Column, source: Column) -> Column:
    """split_reply over columns: array of kind, text and part."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("part", pa.int32())]))

    @F.arrow_udf("array<struct<kind:string,text:string,part:int>>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for replies, sent, sources in batches:
            one = lambda r, m, s: None if r is None else split_reply(r, m or [], {t[0] for t in _ANY.finditer(s or "")})
            yield by_slices(lambda *rows: list(map(one, *rows)), kind, replies, sent, sources)

    return split(reply, marks, source)
