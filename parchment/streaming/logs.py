"""Event logs as streams: exactly-once merges, throttled states, windows, and the life of jobs.

Each takes a streaming (or batch) DataFrame of events. Times must be of type timestamp: cast timestamp_ntz first.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parchment.operators.machines import job_step
from parchment.sources.scratch import scratch_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The events of a Parquet table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    # a single file is found by a pattern that only it fits
    pattern = f"{path[:-1]}[{path[-1]}]"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each event once: repeats by key within the watermark are dropped, and their state goes with it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def throttled(events: DataFrame, key: str, seq: str, every: str, columns: list[str]) -> DataFrame:
    """The latest state of each key in each stretch of time."""
    return events.groupBy(key, F.window("ts", every).alias("w")).agg(F.max_by(F.struct(*columns), seq).alias("__s"), F.max(seq).alias(seq)).select(key, F.col("w.start").alias("slot"), seq, "__s.*")


def windowed_counts(events: DataFrame, every: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def lifecycle(events: DataFrame, key: str = "user_id", key_type: str = "long") -> DataFrame:
    """The status of each job after each batch of events (seq, t_ms, outcome, permanent): key, seq, status, attempts.

    The state of a job is four numbers and words; a batch's events of a job are put in order by seq. No event may come in a
    later batch than one of greater seq of its job: that is an error, and collect_in_order deals a table out so.
    """

    def go_on(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, due, seq = state.get if state.exists else ("queued", 0, 0, -1)
        job = {"status": status, "attempts": attempts, "due": due}
        rows = (zip(*(b[c].tolist() for c in ("seq", "outcome", "permanent", "t_ms")), strict=True) for b in batches)
        here = sorted(itertools.chain.from_iterable(rows), key=lambda e: e[0])
        if here[0][0] < seq:
            raise ValueError(f"event {here[0][0]} of {k[0]} comes after {seq}: give the events in order (collect_in_order)")
        for _, outcome, permanent, t_ms in here:
            job_step(job, outcome, bool(permanent), t_ms)
        seq = here[-1][0]
        state.update((job["status"], job["attempts"], job["due"], int(seq)))
        yield pd.DataFrame({key: [k[0]], "seq": [seq], "status": [job["status"]], "attempts": [job["attempts"]]})

    return events.groupBy(key).applyInPandasWithState(go_on, f"{key} {key_type}, seq long, status string, attempts long", "status string, attempts long, due long, seq long", "update", GroupStateTimeout.NoTimeout)


def collect_stream(result: DataFrame, keys: list[str], order: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and return its rows; of rows with equal keys the one of the greatest order.

    Every micro-batch is written to a folder named by its number, so one that is run again after a failure replaces itself.
    """
    spark = result.sparkSession
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    _run(result, out, checkpoint, mode)
    return _latest(result, out, keys, order)


def _run(result: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def _latest(result: DataFrame, out: str, keys: list[str], order: str) -> DataFrame:
    rows = result.sparkSession.read.schema(f"{_ddl(result)}, batch long").parquet(out)
    latest = F.max_by(F.struct(*[c for c in result.columns if c not in keys]), F.struct(F.col(order), F.col("batch"))).alias("__r")
    return rows.groupBy(*keys).agg(latest).select(*keys, "__r.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def collect_in_order(events: DataFrame, order: Column, build: Callable[[DataFrame], DataFrame], keys: list[str], by: str, mode: str = "append", rows: int = 1_000_000) -> DataFrame:
    """collect_stream of build(the events as a stream), with all events in order, whatever files they lie in.

    The table is dealt into ranges of order (a number) of about so many rows. Each range is appended to a log once the one
    before it is done, and the stream goes on from its checkpoint, so a range is one micro-batch. Equal orders share a range.
    """
    spark = events.sparkSession
    staged, log, out, checkpoint = (scratch_path(spark, name) for name in ("ranges", "log", "stream", "stream-state"))
    ranges = -(-events.count() // rows) or 1
    cuts = sorted(set(events.select(order.cast("double").alias("o")).approxQuantile("o", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    number = F.size(F.filter(F.lit(cuts), lambda c: c <= order.cast("double"))) if cuts else F.lit(0)
    events.withColumn("__range", number).write.partitionBy("__range").parquet(staged)
    for i in range(len(cuts) + 1):
        spark.read.schema(f"{_ddl(events)}, __range int").parquet(staged).filter(F.col("__range") == i).drop("__range").write.mode("append").parquet(log)
        result = build(spark.readStream.schema(events.schema).parquet(log))
        _run(result, out, checkpoint, mode)
    return _latest(result, out, keys, by)
