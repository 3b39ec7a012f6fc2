"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is a line. It has a vector of two parts. LANES lanes of LANE_BITS bits are drawn from the SHA-256 digest of the
paragraph. In SKETCH lanes of SKETCH_BITS bits each shingle of its words adds 1 or -1 to one lane. The fingerprint of a
text is the sum of the vectors of its paragraphs, each lane modulo its power of two. So the order of paragraphs doesn't
count, and a paragraph is inserted or deleted by adding or taking away its own fingerprint. Of two texts, the first
part tells whether their paragraphs are the same; the difference of the second has a squared length of about the number of
shingles that only one of them has.

Everything here is built of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import column, one_each, shuffle_partitions, without, write_table

LANES, LANE_BITS = 16, 32
SKETCH, SKETCH_BITS = 128, 24
#: Words of a shingle; the last ones of a paragraph have fewer.
WORDS = 3
_WIDTHS = [LANE_BITS // 4] * LANES + [SKETCH_BITS // 4] * SKETCH
#: The fingerprint of no paragraph at all.
NOTHING = "0" * sum(_WIDTHS)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once."""
    return F.transform(F.array(value), then)[0]


def _hex(lanes: Column, bits: int) -> Column:
    """Lanes modulo 2**bits, one after another, as lowercase hexadecimal digits."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << bits) - 1)))), bits // 4, "0")), "")


def _counted(codes: Column) -> Column:
    """For each sketch lane, how often codes (from 0 to 2 * SKETCH - 1) has its even code, less how often its odd one."""

    def lanes(s: Column) -> Column:
        # s is sorted and has each code once more than codes, so where codes begin gives their counts
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (s[i] != F.get(s, i - 1)))
        return _let(F.concat(begins, F.array(F.size(s))), lambda at: F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda j: (2 * at[2 * j + 1] - at[2 * j] - at[2 * j + 2]).cast("long")))

    return _let(F.sort_array(F.concat(codes, F.sequence(F.lit(0), F.lit(2 * SKETCH - 1)))), lanes)


def vector(text: Column) -> Column:
    """The sum of the vectors of a text's paragraphs: exact and sketch, two arrays of numbers. Null counts as empty.

    An empty text is one empty paragraph.
    """
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def of(own: Column) -> Column:
        exact = _let(
            F.transform(own, lambda p: F.sha2(F.encode(p, "utf-8"), 256)),
            lambda digests: F.transform(
                F.sequence(F.lit(0), F.lit(LANES - 1)),
                lambda k: F.aggregate(digests, F.lit(0).cast("long"), lambda s, d: (s + F.shiftrightunsigned(F.xxhash64(k, d), 64 - LANE_BITS)).bitwiseAND(F.lit((1 << LANE_BITS) - 1))),
            ),
        )
        shingle = lambda words: F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WORDS)]).bitwiseAND(F.lit(2 * SKETCH - 1)).cast("int"))
        codes = F.flatten(F.transform(F.filter(own, lambda p: p != ""), lambda p: _let(F.split(p, " "), shingle)))
        return F.struct(exact.alias("exact"), _counted(codes).alias("sketch"))

    return _let(paragraphs, of)


def written(v: Column) -> Column:
    """A vector as a fingerprint: its lanes modulo their powers of two, in hexadecimal digits."""
    return F.concat(_hex(v["exact"], LANE_BITS), _hex(v["sketch"], SKETCH_BITS))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    return _let(vector(text), written)


def read_back(fp: Column) -> Column:
    """The vector of a fingerprint."""

    def lanes(first: int, digits: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.conv(F.substr(fp, first + j * digits, F.lit(digits)), 16, 10).cast("long"))

    return F.struct(lanes(1, LANE_BITS // 4, LANES).alias("exact"), lanes(1 + LANES * LANE_BITS // 4, SKETCH_BITS // 4, SKETCH).alias("sketch"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    both = lambda v, w: F.struct(*[F.zip_with(v[part], w[part], lambda x, y: x + sign * y).alias(part) for part in ("exact", "sketch")])
    return _let(read_back(a), lambda v: _let(read_back(b), lambda w: written(both(v, w))))


def inserted(fp: Column, more: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return _combined(fp, more, 1)


def deleted(fp: Column, gone: Column) -> Column:
    """The fingerprint of what is left of fp's paragraphs without those of gone."""
    return _combined(fp, gone, -1)


def _signed(x: Column) -> Column:
    """x modulo 2**SKETCH_BITS, from minus half of that on."""
    half = 1 << (SKETCH_BITS - 1)
    return (x + F.lit(half)).bitwiseAND(F.lit(2 * half - 1)) - F.lit(half)


def vector_likeness(v: Column, w: Column) -> Column:
    """likeness() of two vectors; whether they are equal is seen in all lanes."""
    square = lambda lanes: F.aggregate(lanes, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    apart = square(F.zip_with(v["sketch"], w["sketch"], lambda x, y: _signed(x - y)))
    length = square(F.transform(F.concat(v["sketch"], w["sketch"]), _signed))
    share = _let(length, lambda n: F.when(n > 0, F.greatest(F.lit(0.0), 1 - apart / n)).otherwise(0.0))
    return F.when((v["exact"] == w["exact"]) & (v["sketch"] == w["sketch"]), F.lit(1.0)).otherwise(share)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: about the share of shingles that two fingerprinted texts have in common; 1 if the fingerprints are equal.

    This is 1 - |a - b|² / (|a|² + |b|²) over the sketch lanes. Its standard error is below 1 / sqrt(SKETCH), and smaller for like
    texts. Of texts without words it is 0 unless they are equal. A lane wraps when one shingle occurs 2**23 times.
    """
    return _let(read_back(a), lambda v: _let(read_back(b), lambda w: vector_likeness(v, w)))


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of the text, row by row: nothing is shuffled and no key can be hot.

    Null texts count as empty. Rows with equal texts get equal fingerprints. A column named as out is replaced.
    """
    return docs.select(*without(docs, out), fingerprint(column(text_col)).alias(out))


def _cut_points(keys: DataFrame, ranges: int) -> tuple[list[int], list[int]]:
    """The least keys (o, h) of so many ranges of about equal size; empty ranges have none."""
    placed = keys.select("o", "h").repartitionByRange(ranges, "o", "h").select("o", "h", F.spark_partition_id().alias("range"))
    cuts = sorted({(r.o, r.h) for r in placed.groupBy("range").agg(F.min(F.struct("o", "h")).alias("cut")).select("cut.*").collect()})
    return [o for o, _ in cuts], [h for _, h in cuts]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """id, text, vector, next_text and next_vector: each document beside the next one by descending id (after the last: the first).

    Ids are whole numbers; null ids (and -2**63) come last, equal ids are in order of a hash of the text, null texts count as empty. Rows that
    repeat id and text follow each other. One document is its own next.

    Ids are cut into ranges, 8 for each shuffle partition unless ranges says otherwise; the driver has the least id of each. The first row of a
    range also stands, as a guest, at the end of the range before it. So texts are shuffled once, and a range finds all it needs in itself.
    Rows that repeat id and text are one row with a number of copies on the way.
    """
    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    # the complement puts greater ids first and never overflows
    rows = rows.select("id", "text", F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit((1 << 63) - 1)).alias("o"), F.xxhash64("text").alias("h"))
    keys = write_table(rows.groupBy("none", "o", "h").agg(F.count("*").alias("n")), "keys")
    repeated = write_table(keys.filter("n > 1"), "repeated-documents")
    rows = one_each(rows, ["none", "o", "h"], repeated)

    low, high = _cut_points(keys, ranges or 8 * shuffle_partitions(docs.sparkSession))
    n = len(low)
    numbers = lambda of: F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>") if of else F.array().cast("array<bigint>")
    lows, highs = numbers(low), numbers(high)
    not_after = lambda i: (F.get(lows, i) < F.col("o")) | ((F.get(lows, i) == F.col("o")) & (F.get(highs, i) <= F.col("h")))
    halves = F.array(*[F.lit(1 << k) for k in range(max(1, n.bit_length()) - 1, -1, -1)])
    found = F.aggregate(halves, F.lit(0), lambda at, step: F.when((at + step <= n) & not_after(at + step - 1), at + step).otherwise(at))
    rows = rows.withColumn("range", found - 1)
    first = (F.get(lows, F.col("range")) == F.col("o")) & (F.get(highs, F.col("range")) == F.col("h"))
    place = lambda at, guest: F.struct(at.alias("range"), F.lit(guest).alias("guest"))
    places = F.when(first, F.array(place(F.col("range"), False), place(F.pmod(F.col("range") - 1, F.lit(max(1, n))), True))).otherwise(F.array(place(F.col("range"), False)))
    dealt = rows.select("id", "text", "o", "h", "n", F.explode(places).alias("place")).select("id", "text", "o", "h", "n", "place.*")
    dealt = dealt.repartition("range").withColumn("vector", vector(F.col("text")))

    follows = Window.partitionBy("range").orderBy("guest", "o", "h")
    out = dealt.select("id", "text", "vector", "n", "guest", *[F.lead(c).over(follows).alias(f"next_{c}") for c in ("text", "vector")]).filter(~F.col("guest"))
    if not repeated.isEmpty():
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        out = out.withColumns({f"next_{c}": F.when(F.col("copy") < F.col("n"), F.col(c)).otherwise(F.col(f"next_{c}")) for c in ("text", "vector")})
    return out.select("id", "text", "vector", "next_text", "next_vector")


def edited(text: Column, other: Column) -> Column:
    """text with the last third of its code points replaced by as many first ones of other, or all of it if it has fewer."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - third), F.substr(other, F.lit(1), third))
