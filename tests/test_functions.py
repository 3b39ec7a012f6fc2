import pytest
from pyspark.sql import functions as F

from parchment.functions import numbers, predicates, text, tokens


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(("given", "want"), [("a/b:c?", "a_b_c_"), ("  ..x.. ", "x"), ("...", "文档"), ("y" * 200, "y" * 120), ("tab\there", "tab_here")])
def test_file_names(spark, given, want):
    assert one(spark, text.sanitize_filename(F.lit(given))) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 KB"), (1, "1 KB"), (1536, "2 KB"), (1023.6 * 1024, "1.0 MB"), (1024**2 * 1.25, "1.3 MB"), (1024**3, "1.00 GB"), (1023.96 * 1024**2, "1.00 GB")])
def test_sizes(spark, n, want):
    assert one(spark, numbers.format_bytes(F.lit(float(n)))) == want


def test_keys_and_redaction(spark):
    assert one(spark, text.split_keys(F.lit(" a,b，c;d\n"))) == ["a", "b", "c", "d"]
    assert one(spark, text.mask_key(F.lit("sk-123456789"))) == "••••••••6789"
    assert one(spark, text.mask_key(F.lit("short,other"))) == "••••••••（共 2 个）"
    assert one(spark, text.redact(F.lit("key abc here"), ["abc", ""])) == "key [redacted] here"


@pytest.mark.parametrize(("given", "want"), [("<json>[1]</json>", "[1]"), ("```json\n{}\n```", "{}"), ("``` x ```", "x"), ("plain", "plain")])
def test_json_is_unwrapped(spark, given, want):
    assert one(spark, text.clean_json_output(F.lit(given))) == want


def test_replies_lose_reasoning_once(spark):
    assert one(spark, text.clean_reply(F.lit(" <think>a\nb</think>c<think>d</think>"))) == "c<think>d</think>"
    assert one(spark, text.collapse_punctuation(F.lit("a" + "." * 19))) == "a" + "." * 19
    assert one(spark, text.collapse_punctuation(F.lit("a" + "。" * 20))) == "a."


@pytest.mark.parametrize(("spec", "page", "want"), [("1-3,5,8-", 4, False), ("1-3,5,8-", 99, True), ("-3", 2, True), ("", 7, True), (None, 7, True), ("2", 2, True), ("x", 1, None)])
def test_page_ranges(spark, spec, page, want):
    assert one(spark, predicates.page_selected(F.lit(spec).cast("string"), F.lit(page))) is want


@pytest.mark.parametrize(("spec", "want"), [("", None), ("1-3", None), ("3-1", "order"), ("0", "order"), ("1--2", "form"), ("a", "form")])
def test_page_range_problems(spark, spec, want):
    assert one(spark, predicates.page_range_problem(F.lit(spec))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("1.2.10", "1.2.9", True), ("v2", "1.9", True), ("1.0", "1.0.0", False), ("1.0-beta", "1.0", False), ("1.0.1", "1.0-beta", True)])
def test_versions(spark, a, b, want):
    assert one(spark, predicates.version_newer(F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(
    ("status", "body", "want"),
    [(401, "", "credential"), (403, "rate limit", "rateLimited"), (403, "nothing", "fatal"), (429, "insufficient", "credential"), (429, "", "rateLimited"), (400, "Context length", "oversized"), (400, "", "rejected"), (418, "", "rejected"), (522, "", "transient"), (200, "blocked", "refused"), (600, "", "transient")],
)
def test_http_errors(spark, status, body, want):
    assert one(spark, predicates.classify_http(F.lit(status), F.lit(body))) == want


def test_texts_that_are_not_translated(spark):
    assert not one(spark, predicates.needs_translation(F.lit(" {v12} "))) and one(spark, predicates.needs_translation(F.lit("{v1} x")))
    assert one(spark, predicates.is_numeric(F.lit(" -12.5 "))) and not one(spark, predicates.is_numeric(F.lit("1,2")))
    assert one(spark, predicates.is_cid(F.lit("(cid:1)" * 9 + "x"))) and not one(spark, predicates.is_cid(F.lit("(cid:1)xx")))
    assert one(spark, predicates.is_placeholder_only(F.lit("{v1} {v2}"))) and not one(spark, predicates.is_placeholder_only(F.lit("")))


def test_formula_fonts_and_characters(spark):
    font = lambda f: one(spark, predicates.is_formula_font(F.lit(f), [".*NewCM.*"], [".*Times.*", ".*Symbol.*"]))
    assert font("ABC+CMMI10") and font("NewCMSymbol") and not font("X+TimesMath") and not font("Arial") and not font("")
    char = lambda c: one(spark, predicates.is_formula_char(F.lit(c)))
    assert char("α") and char("+") and char("(cid:3)") and char(" ") and not char(" ") and not char("a")


def test_times(spark):
    assert one(spark, numbers.format_elapsed(F.lit(3_723_999))) == "1:02:03" and one(spark, numbers.format_elapsed(F.lit(-5))) == "0:00"
    at, now = F.lit("2024-05-01 23:50:00").cast("timestamp"), lambda t: F.lit(t).cast("timestamp")
    told = lambda t: one(spark, numbers.relative_time(at, now(t)))
    assert [told("2024-05-01 23:50:30"), told("2024-05-02 00:05:00"), told("2024-05-02 08:00:00"), told("2024-06-02 08:00:00"), told("2025-06-02 08:00:00")] == ["刚刚", "15 分钟前", "昨天", "5月1日", "2024年5月1日"]
    wait = lambda h: one(spark, numbers.retry_after_ms(F.lit(h).cast("string"), now("2024-05-01 00:00:00")))
    assert [wait("2"), wait("9999"), wait("Wed, 01 May 2024 00:00:10 GMT"), wait("soon"), wait(None)] == [2000, 300_000, 10_000, None, None]


def test_geometry(spark):
    ident = [F.lit(float(x)) for x in (1, 0, 0, 1, 5, 6)]
    box = one(spark, numbers.corner_box(numbers.multiply(ident, ident), F.lit(2.0), F.lit(3.0)))
    assert (box.x0, box.y0, box.x1, box.y1, box.angle) == (10, 12, 12, 15, 0)
    assert one(spark, numbers.bankers_round(F.lit(2.5))) == 2 and one(spark, numbers.round_half_up(F.lit(2.5))) == 3
    assert one(spark, numbers.normalise_colour(F.lit("cmyk"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.5))))) == [0, 0.5, 0.5]


def test_tokens(spark):
    assert one(spark, tokens.normalize_spaces(F.lit("ﬁ　①  x"))) == "fi 1 x"
    known = F.create_map(F.lit("A"), F.lit("A"))
    glyph = lambda n: one(spark, tokens.glyph_text(F.lit(n), known))
    assert [glyph("A.alt"), glyph("uni00410042"), glyph("u1F600"), glyph("A_uni0043"), glyph("nope")] == ["A", "AB", "😀", "AC", None]
    assert one(spark, tokens.without_foreign(F.lit("a {v1} {v2}{"), F.array(F.lit("{v1}")))) == "a {v1} {"


def test_templates(spark):
    assert one(spark, text.substitute(F.lit("$a $$a $b"), {"a": F.lit("$b")})) == "$b $a $b"
    assert one(spark, text.fill_braces(F.lit("{{a}} {a}"), {"a": F.lit("{a}")})) == "{a} {a}"
