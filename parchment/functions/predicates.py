"""Predicates and classifications: each takes and returns columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import SPACE, hit_ratio, strip

ACTIVE, FAILED = ("queued", "processing", "retrying"), ("failed", "cancelled")

# The stages in their order.
STAGES = ["received", "inspect", "analyze", "translate", "compose", "verify", "archive"]

# Errors that a retry can't mend.
PERMANENT_ERRORS = [
    "pdf_encrypted", "pdf_invalid", "pdf_empty", "pdf_too_long", "pdf_open", "page_geometry", "scanned_pdf", "scanned_with_text", "pages_out_of_range", "no_paragraphs",
    "font_embed_failed", "layout_model_missing", "mostly_untranslated", "keychain_unavailable", "models_unsupported", "not_found",
]

# What a provider's error body says, by the kind of error, tried in this order.
BODY_PATTERNS = [
    ("oversized", "context length|context_length|maximum context|too many tokens|token limit|max_tokens|input is too long|prompt is too long"),
    ("refused", "content_filter|content filter|safety|sensitive|violat|inappropriate|blocked"),
    ("credential", "invalid api key|invalid_api_key|incorrect api key|authentication|unauthorized|api key not valid|permission denied"),
    ("fatal", "model not found|does not exist|no such model|unknown model|not supported model|model_not_found"),
    ("rateLimited", "rate limit|rate_limit|too many requests|quota exceeded|throttl"),
]

# Characters of a sample, in sum and on average for a page, below which it has no text layer; the wait after a rate limit.
SCAN_CHARS, SCAN_MEAN_CHARS, RATE_LIMIT_WAIT_MS = 200, 25, 5000

# Fixed value: fonts of formulas when neither list of font names knows them.
FORMULA_FONT = "^(CM[^RB]|(MS|XY|MT|BL|RM|EU|LA|RS)[A-Z]|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Sym|.*Math|AdvP4C4E74|AdvPSSym|AdvP4C4E59)"


def status_bucket(status: Column) -> Column:
    return F.when(status == "completed", "completed").when(status.isin(*FAILED), "failed").otherwise("active")


def in_bucket(status: Column, wanted: str) -> Column:
    return F.lit(True) if wanted == "all" else status_bucket(status) == wanted


def matches_query(title: Column, filename: Column, query: str) -> Column:
    """Every word of the query is somewhere in title or file name, whatever the case; a blank query matches all."""
    hay = F.lower(F.concat(title, F.lit("\n"), filename))
    return reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in query.lower().split()], F.lit(True))


def needs_translation(text: Column) -> Column:
    return (strip(text) != "") & ~strip(text).rlike(r"^\{v\d+\}$")


def is_numeric(text: Column) -> Column:
    return strip(text).rlike(r"^-?\p{Nd}+(\.\p{Nd}+)?$")


def is_cid(text: Column) -> Column:
    """More than four fifths of the characters are codes without a character."""
    return hit_ratio(text, r"\(cid:\d+\)") > 0.8


def is_placeholder_only(text: Column, mark: str = r"\{v\d+\}") -> Column:
    """Nothing but whitespace besides the placeholders; not so for an empty text."""
    return (text != "") & F.regexp_replace(text, mark, "").rlike(f"^[{SPACE}]*$")


def font_name(font: Column) -> Column:
    return F.element_at(F.split(font, r"\+"), -1)


def is_formula_font(font: Column, math_fonts: list[str], text_fonts: list[str]) -> Column:
    """Fonts known for mathematics, then fonts known for text, then a broad pattern; a subset's prefix doesn't count."""
    name = font_name(font)
    known = lambda fonts: name.rlike(f"^({'|'.join(fonts)})$") if fonts else F.lit(False)
    return F.when(name == "", False).when(known(math_fonts), True).when(known(text_fonts), False).otherwise(name.rlike(FORMULA_FONT))


def is_formula_char(char: Column) -> Column:
    """A code without a character, a modifier, mark, sign or separator, or a Greek letter; a plain space is none."""
    return char.startswith("(cid:") | ((char != " ") & char.rlike(r"^([\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}]|[\x{370}-\x{3FF}])"))


def parse_pages(spec: Column) -> Column:
    """ "1-3,5,8-" as ranges (first, last), last -1 for an open end; null for an empty text or one in another form."""
    parts = F.transform(F.split(spec, ","), lambda p: F.btrim(p))
    bounds = lambda p: F.struct(
        F.when(p.rlike("^-"), F.lit(1)).otherwise(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")).alias("first"),
        F.when(p.endswith("-"), F.lit(-1)).when(p.contains("-"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int")).otherwise(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")).alias("last"),
    )
    return F.when(F.forall(parts, lambda p: p.rlike(r"^(\d+|\d*\s*-\s*\d*)$")), F.transform(F.transform(parts, lambda p: F.regexp_replace(p, r"\s", "")), bounds))


def page_selected(spec: Column, page: Column) -> Column:
    """Whether a page, from 1, is in the ranges; an empty or missing text selects all pages."""
    return F.when(F.coalesce(spec, F.lit("")) == "", True).otherwise(F.exists(parse_pages(spec), lambda r: (r["first"] <= page) & ((r["last"] == -1) | (page <= r["last"]))))


def page_range_problem(spec: Column) -> Column:
    """"form", "order", or null when the ranges are right."""
    ranges = parse_pages(spec)
    wrong = F.exists(ranges, lambda r: (r["first"] < 1) | ((r["last"] != -1) & (r["last"] < r["first"])))
    return F.when(F.btrim(spec) == "", F.lit(None)).when(ranges.isNull(), "form").when(wrong, "order")


def looks_like_title(text: Column) -> Column:
    bare = strip(text)
    return F.length(bare).between(3, 300) & ~F.lower(bare).endswith(".pdf") & ~bare.rlike(r"^\d+$")


def is_cancellable(status: Column, stage: Column) -> Column:
    return status.isin(*ACTIVE) & ~((status == "processing") & (stage == "archive"))


def is_permanent(code: Column) -> Column:
    return code.isin(*PERMANENT_ERRORS)


def ends_document(kind: Column) -> Column:
    return kind.isin("user", "exhausted", "fatal", "credential")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def classify_body(lower: Column) -> Column:
    found = reduce(lambda c, p: c.when(lower.rlike(p[1]), p[0]), BODY_PATTERNS[1:], F.when(lower.rlike(BODY_PATTERNS[0][1]), BODY_PATTERNS[0][0]))
    return found.when(lower.contains("insufficient") & lower.rlike("balance|quota|credit"), "credential")


#: Kinds of errors that the HTTP status alone decides. Fixed values.
STATUS_KINDS = {
    "credential": [401, 402],
    "fatal": [404],
    "transient": [408, 409, 425, 500, 502, 503, 504, 520, 521, 522, 523, 524, 525, 526, 527, 528, 529],
    "oversized": [413],
}
#: What the statuses are that leave the kind to the body, where the body says nothing. Fixed values.
UNSAID_KINDS = {"rejected": [400, 422], "fatal": [403]}


def classify_http(status: Column, body: Column) -> Column:
    """The kind of a provider's error by its HTTP status and, where that leaves it open, by what the body says.

    The statuses of STATUS_KINDS have theirs; those of UNSAID_KINDS and successes have what the body says. Too many requests, and a forbidden one
    whose body speaks of a rate limit, are rate limits, unless a 429 is for want of credit. Of what is left, 4xx is rejected and all else transient.
    """
    table = lambda kinds: F.create_map(*[F.lit(x) for kind, codes in kinds.items() for code in codes for x in (code, kind)])

    def kind_of(status: Column, lower: Column, whole: Column) -> Column:
        unpaid = lower.contains("insufficient") | lower.contains("exceeded your current quota")
        limited = F.when(status == 429, ~F.coalesce(unpaid, F.lit(False))).when(status == 403, lower.contains("rate") & lower.contains("limit"))
        unsaid = F.coalesce(F.try_element_at(table(UNSAID_KINDS), whole), F.when(status.between(200, 299), "transient"))
        by_rule = F.when(limited, "rateLimited").when(status == 429, "credential").when(unsaid.isNotNull(), F.coalesce(classify_body(lower), unsaid))
        return F.coalesce(F.try_element_at(table(STATUS_KINDS), whole), by_rule, F.when(status.between(400, 499), "rejected"), F.lit("transient"))

    given = F.struct(status.alias("status"), F.lower(body).alias("lower"))
    return let(given, lambda g: kind_of(g["status"], g["lower"], F.when(g["status"].cast("int") == g["status"], g["status"].cast("int"))))


def classify_reply(status: Column, body: Column) -> Column:
    """classify_http, but a success whose body has an object "error" counts as the status that is its code or status, if that is a number from 400 to 599."""
    embedded = lambda c: F.when((c >= 400) & (c < 600), c)
    coded = lambda error: let(F.from_json(error, "code double, status double"), lambda t: F.coalesce(embedded(t["code"]), embedded(t["status"]), F.lit(200.0)))

    def read(g: Column) -> Column:
        inside = g["status"].between(200, 299) & g["error"].startswith("{")
        return F.struct(F.when(inside, coded(g["error"])).otherwise(g["status"].cast("double")).alias("status"), F.when(inside, g["error"]).otherwise(g["body"]).alias("body"))

    given = F.struct(status.alias("status"), body.alias("body"), F.get_json_object(body, "$.error").alias("error"))
    return let(given, lambda g: let(read(g), lambda r: classify_http(r["status"], r["body"])))


def wait_for(kind: Column, retry_after_ms: Column) -> Column:
    """Milliseconds to wait after an error: what the provider asks for, else five seconds after a rate limit, else null."""
    return F.coalesce(retry_after_ms, F.when(kind == "rateLimited", RATE_LIMIT_WAIT_MS))


def lacks_text_layer(chars: Column, mean: Column) -> Column:
    """Whether pages with so many characters in sum and on average are taken for scans."""
    return (chars < SCAN_CHARS) & (mean < SCAN_MEAN_CHARS)


def version_newer(candidate: Column, current: Column) -> Column:
    """Whether a version is newer: numbers between dots and dashes, one after another; what is missing or no number is 0."""
    numbers = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), r"[.-]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    differences = F.filter(F.zip_with(numbers(candidate), numbers(current), lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))), lambda d: d != 0)
    return F.coalesce(F.get(differences, F.lit(0)) > 0, F.lit(False))


def stage_state(status: Column, stage: Column, wanted: str) -> Column:
    """What a document's state means for one stage: done, running, failed, cancelled or waiting."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    here = STAGES.index(wanted) + 1
    stopped = F.when(status.isin(*FAILED), status).otherwise("running")
    return F.when((status == "completed") | (stage == "done") | (at > here), "done").when(at == here, stopped).otherwise("waiting")
