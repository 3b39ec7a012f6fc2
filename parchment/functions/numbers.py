"""Numbers, durations and geometry: each function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds that a provider may ask to wait at most.
LONGEST_WAIT_MS = 300_000
#: Boxes less sure than this are dropped.
LEAST_CONFIDENCE = 0.25


def bankers_round(x: Column) -> Column:
    return F.bround(x, 0)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def fixed(x: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f", x)


def format_bytes(n: Column) -> Column:
    """Whole KB, at least 1; MB with one decimal; from 1 GB on GB with two. Rounding comes first, so 1023.6 KB are 1.0 MB."""
    kb, mb = n / 1024, n / 1024 / 1024
    return (
        F.when(n.isNull() | (n <= 0), "0 KB")
        .when(round_half_up(kb) < 1024, F.concat(F.greatest(F.lit(1), round_half_up(kb)).cast("string"), F.lit(" KB")))
        .when(F.round(mb, 1) < 1024, F.concat(fixed(mb, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(mb / 1024, 2), F.lit(" GB")))
    )


def format_elapsed(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(ms.isNull(), F.lit(None)).when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%d:%02d", m, rest))


def elapsed_ms(status: Column, started: Column, completed: Column, updated: Column, now: Column) -> Column:
    """From the start to now for documents in work, else to where they ended; null if they never started, never below 0."""
    end = F.when(status.isin("queued", "processing", "retrying"), now).otherwise(F.coalesce(completed, updated))
    return F.when(started.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(end) - F.unix_millis(started)))


# How times are told.
JUST_NOW, MINUTES_AGO, YESTERDAY, HOURS_AGO = "刚刚", " 分钟前", "昨天", " 小时前"


def relative_time(at: Column, now: Column) -> Column:
    """Minutes within an hour, then yesterday or hours of today, then the date; without the year within this year."""
    ms = F.unix_millis(now) - F.unix_millis(at)
    day = F.concat(F.month(at), F.lit("月"), F.dayofmonth(at), F.lit("日"))
    return (
        F.when(ms < 60_000, JUST_NOW)
        .when(ms < 3_600_000, F.concat(F.floor(ms / 60_000), F.lit(MINUTES_AGO)))
        .when(F.to_date(at) == F.date_sub(F.to_date(now), 1), YESTERDAY)
        .when(F.to_date(at) == F.to_date(now), F.concat(F.greatest(F.lit(1), F.floor(ms / 3_600_000)), F.lit(HOURS_AGO)))
        .when(F.year(at) == F.year(now), day)
        .otherwise(F.concat(F.year(at), F.lit("年"), day))
    )


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds to wait by a header of seconds or of an HTTP date; null if it is neither."""
    seconds = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    ms = F.when(seconds >= 0, seconds * 1000).otherwise((F.unix_millis(date) - F.unix_millis(now)).cast("double"))
    return F.when(ms.isNotNull(), F.least(F.lit(float(LONGEST_WAIT_MS)), F.greatest(F.lit(0.0), ms)))


def backoff_ms(attempt: Column, retry_after: Column, jitter: Column | float = 0) -> Column:
    """Doubling from 1 s to 32 s; what the provider asks for counts, but half of that is waited in any case."""
    base = F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(32.0)) * 1000
    return F.greatest(F.coalesce(retry_after.cast("double"), base), base / 2) + jitter


def retry_delay_s(attempts: Column) -> Column:
    return (attempts + 1) * 20


def stage_progress(done: Column, total: Column, start: int, span: int) -> Column:
    return start + round_half_up(F.least(F.lit(1.0), done / total) * span)


def stage_timeout_ms(pages: Column, per_page_ms: int) -> Column:
    return F.greatest(F.lit(120_000), pages * per_page_ms)


def mean_progress(progress: Column) -> Column:
    """An aggregate: the mean of percentages as a share from 0 to 1, and -1 if there are none."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(progress) / 100)), F.lit(-1.0))


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """Of two affine maps (a, b, c, d, e, f), the one that applies m first and then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def inverse(m: list[Column]) -> list[Column]:
    """The map that takes back an affine one; nulls where it has none."""
    a, b, c, d, e, f = m
    whole = F.nullif(a * d - b * c, F.lit(0.0))
    p, q, r, s = d / whole, -b / whole, -c / whole, a / whole
    return [p, q, r, s, -(e * p + f * r), -(e * q + f * s)]


def apply_matrix(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def page_matrix(rotate: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The map from a page's own space to the upright page, as an array of six."""
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = {90: [zero, -one, one, zero, -y0, x1], 180: [-one, zero, zero, -one, x1, y1], 270: [zero, one, -one, zero, y1, -x0]}
    out = F.array(one, zero, zero, one, -x0, -y0)
    for angle, row in rows.items():
        out = F.when(rotate == angle, F.array(*row)).otherwise(out)
    return out


def corner_box(m: list[Column], width: Column, height: Column) -> Column:
    """The upright box around a width x height cell under an affine map, and the angle of its base line in degrees."""
    corners = [apply_matrix(m, x, y) for x in (F.lit(0.0), width) for y in (F.lit(0.0), height)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), F.degrees(F.atan2(m[1], m[0])).alias("angle"))


def unscale(v: Column, size: Column, other: Column, page: Column, page_other: Column) -> Column:
    """A detector's coordinate on its padded input back on the page; stored as a float."""
    gain = F.least(size / page, other / page_other)
    pad = bankers_round((size - page * gain) / 2 - 0.1)
    return ((v - pad) / gain).cast("float")


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def within_vertically(a: list[Column], b: list[Column]) -> Column:
    return ((a[1] >= b[1]) & (a[3] <= b[3])) | ((b[1] >= a[1]) & (b[3] <= a[3]))


def normalise_colour(kind: Column, v: Column) -> Column:
    """Gray, RGB or CMYK components from 0 to 1 as an array of RGB; null for another kind."""
    part = lambda i: F.get(v, F.lit(i))
    ink = lambda i: (1 - part(i)) * (1 - part(3))
    return F.when(kind == "gray", F.array(part(0), part(0), part(0))).when(kind == "rgb", F.slice(v, 1, 3)).when(kind == "cmyk", F.array(ink(0), ink(1), ink(2)))
