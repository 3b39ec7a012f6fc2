"""Append-only event logs: rows with a key (the document), seq and what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A log longer than the first number keeps its first event and the newest ones, the second number in all.
MOST, KEPT = 5000, 4000


def tail(events: DataFrame, key: str, limit: int, seq: str = "seq") -> DataFrame:
    """The last events of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc(seq))
    return events.withColumn("__at", F.row_number().over(newest)).filter(F.col("__at") <= max(1, limit)).drop("__at")


def after(events: DataFrame, key: str, cursor: int, limit: int, seq: str = "seq") -> DataFrame:
    """The first events of each key after the cursor; cursor 0 asks for the last ones."""
    if cursor == 0:
        return tail(events, key, limit, seq)
    oldest = Window.partitionBy(key).orderBy(seq)
    return events.filter(F.col(seq) > cursor).withColumn("__at", F.row_number().over(oldest)).filter(F.col("__at") <= max(1, limit)).drop("__at")


def last_seq(events: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return events.groupBy(key).agg(F.max(seq).alias("last_seq"))


def retain(events: DataFrame, key: str, most: int = MOST, kept: int = KEPT, seq: str = "seq") -> DataFrame:
    """Logs of more than most events keep the first and the last kept - 1."""
    oldest, newest = Window.partitionBy(key).orderBy(seq), Window.partitionBy(key).orderBy(F.desc(seq))
    numbered = events.withColumns({"__first": F.row_number().over(oldest), "__last": F.row_number().over(newest)})
    long = F.col("__first") + F.col("__last") - 1 > most
    return numbered.filter(~long | (F.col("__first") == 1) | (F.col("__last") <= kept - 1)).drop("__first", "__last")


def retain_one_by_one(events: DataFrame, key: str, most: int = MOST, kept: int = KEPT, seq: str = "seq") -> DataFrame:
    """What is left of logs whose events came one by one, each log being cut to its first and its last kept - 1 whenever it has more than most.

    So a log of n events, more than most, has kept + (n - most - 1) modulo (most - kept + 1) left. seq counts from 1 without a gap.
    """
    sizes = events.groupBy(F.col(key).alias("__key")).agg(F.max(seq).alias("__n"))
    left = F.when(F.col("__n") <= most, F.col("__n")).otherwise(kept + F.pmod(F.col("__n") - most - 1, F.lit(most - kept + 1)))
    met = events.join(sizes, F.col(key).eqNullSafe(F.col("__key")))
    return met.filter((F.col(seq) == 1) | (F.col(seq) > F.col("__n") - left + 1)).drop("__key", "__n")


def merge(known: DataFrame, pushed: DataFrame, key: str, cap: int = MOST, seq: str = "seq") -> DataFrame:
    """The union by key and seq, in which a pushed event replaces the known one; the newest cap of each key stay."""
    both = known.withColumn("__new", F.lit(0)).unionByName(pushed.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(key, seq).orderBy(F.desc("__new"))
    one = both.withColumn("__at", F.row_number().over(latest)).filter("__at = 1").drop("__at", "__new")
    return tail(one, key, cap, seq)


def latest(events: DataFrame, key: str, columns: list[str], seq: str = "seq") -> DataFrame:
    """The newest event of each key, by one aggregation without a sort."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("__e"), F.max(seq).alias(seq)).select(key, seq, "__e.*")


def number(events: DataFrame, key: str, order: list[str], start: int = 0) -> DataFrame:
    """Give the events of each key the next numbers after start, in order."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") + start)


def gaps(events: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """gap: how far the next event of the key lies ahead, null for the last."""
    return events.withColumn("gap", F.lead(at).over(Window.partitionBy(key).orderBy(*order)) - F.col(at))


def offsets(rows: DataFrame, key: str, height: str, order: list[str]) -> DataFrame:
    """top: the sum of the heights before a row of its key."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.coalesce(F.sum(height).over(before), F.lit(0)))


def in_view(rows: DataFrame, height: str, top: float, bottom: float, overscan: float = 0) -> DataFrame:
    """Of rows with their top, those that meet the view from top to bottom, widened on both sides."""
    return rows.filter((F.col("top") + F.col(height) > max(0, top - overscan)) & (F.col("top") < bottom + overscan))


def peak_in_flight(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """How many spans of a key were open at once at most; one that ends when another starts is closed first."""
    edges = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.*")
    upto = Window.partitionBy(key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("open", F.sum("d").over(upto)).groupBy(key).agg(F.max("open").cast("long").alias("peak"))
