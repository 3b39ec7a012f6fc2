"""The library of documents: lists, counts, queues and neighbours.

Documents are rows with id, title, filename, status, stage and the times created_at, started_at, completed_at,
updated_at and next_attempt_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.predicates import in_bucket, is_cancellable, matches_query, status_bucket
from parchment.functions.text import suggested_names
from parchment.operators.machines import fold


def list_documents(docs: DataFrame, bucket: str = "all", query: str = "") -> DataFrame:
    """Documents of a bucket that match a query, newest first; ids settle ties, so that the order is total."""
    found = docs.filter(in_bucket(F.col("status"), bucket) & matches_query(F.col("title"), F.col("filename"), query))
    return found.orderBy(F.desc("created_at"), F.desc("id"))


def count_documents(docs: DataFrame, query: str = "") -> DataFrame:
    """One row: how many documents match, in all and by bucket."""
    bucket = status_bucket(F.col("status"))
    found = docs.filter(matches_query(F.col("title"), F.col("filename"), query))
    return found.agg(F.count("*").alias("all"), *[F.count_if(bucket == b).alias(b) for b in ("active", "completed", "failed")])


def summary(docs: DataFrame) -> DataFrame:
    """Documents without their settings, with the names that their outputs would have."""
    return docs.drop("settings").withColumn("names", suggested_names(F.col("title"), F.col("filename")))


def queue(docs: DataFrame, free: int | None = None) -> DataFrame:
    """Waiting documents in the order of their turn; free bounds how many may start now."""
    waiting = docs.filter(F.col("status") == "queued").orderBy(F.coalesce("next_attempt_at", "created_at"), "id")
    return waiting if free is None else waiting.limit(free)


def cancellable(docs: DataFrame) -> DataFrame:
    return docs.filter(is_cancellable(F.col("status"), F.col("stage")))


def neighbours(docs: DataFrame, by: list[str]) -> DataFrame:
    """next_id: which document takes the place of each one within its group when it goes: the next, else the one before."""
    order = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("id"))
    return docs.withColumn("next_id", F.coalesce(F.lead("id").over(order), F.lag("id").over(order)))


def step(docs: DataFrame, by: list[str], k: int) -> DataFrame:
    """step_id: the document k places further on within the group, or the first or last one."""
    order, whole = Window.partitionBy(*by).orderBy(F.desc("created_at"), F.desc("id")), Window.partitionBy(*by)
    placed = docs.withColumn("__at", F.row_number().over(order)).withColumn("__n", F.count("*").over(whole))
    goal = placed.select(*by, F.col("__at").alias("__goal"), F.col("id").alias("step_id"))
    placed = placed.withColumn("__goal", F.least(F.col("__n"), F.greatest(F.lit(1), F.col("__at") + k)).cast("int"))
    return placed.join(goal, [*by, "__goal"]).drop("__at", "__n", "__goal")


def enabled_translators(providers: DataFrame) -> DataFrame:
    """A row for each model of the enabled providers that have a key or need none."""
    usable = providers.filter(F.col("enabled") & (F.col("has_key") | F.col("key_optional")))
    return usable.select("provider_id", F.explode("models").alias("model"))


def update_when(docs: DataFrame, changes: DataFrame, keep: list[str], order: str | None = None) -> DataFrame:
    """Compare and set: a change (id, expected, and new values) applies if the document's status is the expected one.

    Of several that would apply to a document the first by order does, or else the one of least values; there is one row for each document.
    """
    new = F.struct(*[F.col(c) for c in keep])
    first = F.min_by(new, F.struct(F.col(order), new)) if order else F.min(new)
    one = changes.groupBy(F.col("id").alias("change_id"), "expected").agg(first.alias("new"))
    met = docs.select(F.struct("*").alias("doc")).join(one, (F.col("doc.id") == F.col("change_id")) & (F.col("doc.status") == F.col("expected")), "left")
    holds = F.col("change_id").isNotNull()
    return met.select(*[(F.when(holds, F.col(f"new.{c}")).otherwise(F.col(f"doc.{c}")) if c in keep else F.col(f"doc.{c}")).alias(c) for c in docs.columns], holds.alias("changed"))


def recover(docs: DataFrame) -> DataFrame:
    """After a crash what was in work, or waited to be tried again, is queued."""
    return docs.withColumn("status", F.when(F.col("status").isin("processing", "retrying"), "queued").otherwise(F.col("status")))


def promote_due(docs: DataFrame, now) -> DataFrame:
    """Documents whose time to try again has come are queued."""
    due = (F.col("status") == "retrying") & (F.coalesce("next_attempt_at", F.lit(now)) <= F.lit(now))
    return docs.withColumn("status", F.when(due, "queued").otherwise(F.col("status")))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """order, and unique: the name, or if it is taken by a row before, the name with the first free one of #1, #2 and so on.

    Names can only meet others that differ in such endings. Where all names of a stem are the stem itself, a row's place among them is its number, by a window.
    Only where some have an ending of their own are names probed: those rows are dealt out by stem, and the state of a task is
    the names given to one such stem. Null names count as empty.
    """

    def step(s: dict, row: tuple) -> tuple:
        found = row.wanted
        while found in s["taken"]:
            s["next"][row.wanted] = s["next"].get(row.wanted, 0) + 1
            found = f"{row.wanted}#{s['next'][row.wanted]}"
        s["taken"].add(found)
        return (found,)

    stems = rows.select(F.regexp_replace(F.coalesce(name, F.lit("")), r"(#\d+)+$", "").alias("stem"), F.col(order), F.coalesce(name, F.lit("")).alias("wanted"))
    ended = stems.filter("wanted <> stem").select("stem").distinct()
    probed = fold(stems.join(ended, "stem", "left_semi"), "stem", [order], lambda: {"taken": set(), "next": {}}, step, "unique string").select(order, "unique")
    place = F.row_number().over(Window.partitionBy("stem").orderBy(order))
    ranked = stems.join(ended, "stem", "left_anti").select(order, "wanted", place.alias("place"))
    return ranked.select(order, F.when(F.col("place") == 1, F.col("wanted")).otherwise(F.concat("wanted", F.lit("#"), F.col("place") - 1)).alias("unique")).unionByName(probed)
