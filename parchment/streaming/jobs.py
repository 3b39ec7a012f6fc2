"""Jobs and logs as keyed state of a stream: retries that come due by timers, events in any order, numbers that go on.

Both processors need a state store that keeps collections: spark.sql.streaming.stateStore.providerClass must be RocksDB's,
which with_state() sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from parchment.operators.machines import job_step
from parchment.sources.scratch import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JOB = "status string, attempts long, due long, seq long, resumed long"
_EARLY = "n array<long>, t_ms array<long>, outcome array<string>, permanent array<boolean>"
#: Numbers that share an entry of early events: each entry that is read or written is a message between Python and Spark.
BLOCK = 512


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _resume(job: dict, t_ms: int) -> None:
    """A retry that is due goes back into the queue."""
    if job["status"] == "retrying" and job["due"] <= t_ms:
        job.update(status="queued", due=0, resumed=job["resumed"] + 1)


class Jobs(StatefulProcessor):
    """The life of one job. Its events bear the numbers 1, 2, 3 and so on, and may come in any order and any batch.

    State is the job (a few numbers), and those events whose predecessors haven't come yet, in blocks of their numbers. A job that waits for a retry has one
    timer, at the time when it is due. The timer of a job that is cancelled or recovered before is deleted.
    """

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _JOB)
        self.early = handle.getMapState("early", "block long", _EARLY)

    def _load(self) -> dict:
        names = ("status", "attempts", "due", "seq", "resumed")
        return dict(zip(names, self.job.get() if self.job.exists() else ("queued", 0, 0, 0, 0), strict=True))

    def _block(self, block: int, read: dict[int, dict]) -> dict[int, tuple]:
        """The early events of a block by their numbers; each block is read once."""
        if block not in read:
            got = self.early.getValue((block,)) if self.early.containsKey((block,)) else ([], [], [], [])
            read[block] = dict(zip(got[0], zip(*got[1:], strict=True), strict=True))
        return read[block]

    def _keep(self, block: int, events: dict[int, tuple]) -> None:
        if events:
            self.early.updateValue((block,), (list(events), *map(list, zip(*events.values(), strict=True))))
        elif self.early.containsKey((block,)):
            self.early.removeKey((block,))

    def _out(self, key: tuple, job: dict) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "seq": [job["seq"]], "status": [job["status"]], "attempts": [job["attempts"]], "resumed": [job["resumed"]]})

    def _save(self, job: dict, waited: int) -> None:
        due = job["due"] if job["status"] == "retrying" else 0
        if waited and waited != due:
            self.handle.deleteTimer(waited)
        if due and due != waited:
            self.handle.registerTimer(due)
        self.job.update((job["status"], job["attempts"], job["due"], job["seq"], job["resumed"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = self._load()
        waited = job["due"] if job["status"] == "retrying" else 0
        here = {int(e.n): (int(e.t_ms), e.outcome, bool(e.permanent)) for got in rows for e in got.itertuples(index=False) if e.n > job["seq"]}
        begun, read = job["seq"], {}
        while (n := job["seq"] + 1) in here or n in self._block(n // BLOCK, read):
            event = here.pop(n, None) or read[n // BLOCK].pop(n)
            _resume(job, event[0])
            job_step(job, event[1], event[2], event[0])
            job["seq"] = n
        changed = {n // BLOCK for n in here} | (set(range((begun + 1) // BLOCK, job["seq"] // BLOCK + 1)) & set(read) if job["seq"] > begun else set())
        for n, event in here.items():
            self._block(n // BLOCK, read)[n] = event
        for block in changed:
            self._keep(block, {n: e for n, e in read[block].items() if n > job["seq"]})
        self._save(job, waited)
        yield self._out(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = self._load()
        _resume(job, expiredTimerInfo.getExpiryTimeInMs())
        self.job.update((job["status"], job["attempts"], job["due"], job["seq"], job["resumed"]))
        yield self._out(key, job)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, key: str = "user_id", late: str | None = "1 day") -> DataFrame:
    """The job after each batch that touches it, or timer of its own: key, seq, status, attempts, resumed (retries that came due).

    events have the key, n (from 1 on without a gap), ts, t_ms, outcome ("start", "done", "error", "cancel", "recover", others do nothing)
    and permanent. An event is taken when all before it have been; one that comes again is passed over. Before an event of later time,
    a retry that is due goes back into the queue; so it does by its timer, when the watermark (late behind the greatest
    ts) passes it. late must cover how far events come out of order, or a timer may come before an event older than it. With late
    None timers go by the clock. Rows of null key or number are left out.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("n").isNotNull()).select(key, "n", "ts", "t_ms", "outcome", F.coalesce("permanent", F.lit(False)).alias("permanent"))
    out = StructType([events.schema[key]]).add("seq", "long").add("status", "string").add("attempts", "long").add("resumed", "long")
    mode = "ProcessingTime" if late is None else "EventTime"
    rows = rows if late is None else rows.withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(Jobs(key), out, "Update", mode)


class Numbers(StatefulProcessor):
    """Gives the events of a key the numbers after the last one it has given, in order of the columns order."""

    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        first = (self.last.get()[0] if self.last.exists() else 0) + 1
        got.insert(0, "seq", range(first, first + len(got)))
        self.last.update((first + len(got) - 1,))
        yield got

    def close(self) -> None:
        pass


def numbered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events of a stream with seq: each key counts on from where the batch before stopped. Null is a key of its own.

    A batch that runs again after a failure starts from the state before it, so it gives the same numbers.
    """
    out = StructType().add("seq", "long")
    for f in events.schema:
        out = out.add(f)
    return events.groupBy(key).transformWithStateInPandas(Numbers(order), out, "Append", "None")


class NumberedLog:
    """A log in a folder: events with numbers (events/batch=...), and rows that break the rules (refused/batch=...).

    append() takes in what has come to the source since the last time. Each micro-batch is written to a folder of its
    number, so one that runs twice replaces itself and adds nothing. The source is only ever added to.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, order: list[str], valid: Column) -> None:
        self.spark, self.folder, self.schema, self.key, self.order = with_state(spark), folder, schema, key, order
        self.valid = F.coalesce(valid, F.lit(False))

    def append(self, source: str, files_per_trigger: int = 64) -> None:
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        self._run(numbered(rows.filter(self.valid), self.key, self.order), "events")
        self._run(rows.filter(~self.valid), "refused")

    def _run(self, rows: DataFrame, name: str) -> None:
        def write(batch: DataFrame, number: int) -> None:
            write_batch(batch, f"{self.folder}/{name}", number)

        rows.writeStream.option("checkpointLocation", f"{self.folder}/{name}-state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    def read(self, name: str = "events") -> DataFrame:
        schema = StructType([*(StructType().add("seq", "long") if name == "events" else StructType()), *self.schema])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").select(*schema.names)


def write_batch(batch: DataFrame, folder: str, number: int) -> None:
    """Batch number of a log; writing it again replaces it."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def run_jobs(events: DataFrame, key: str, now: str, late: str = "36500 days", files_per_trigger: int = 2) -> DataFrame:
    """lifecycle() over the files of events (written anew as a log, in no order), until the clock shows now.

    While the log is read the watermark stays behind all events, as they are in no order. Then one row without a key tells the time, which
    the watermark follows, and the retries that are due by then come back by their timers.
    """
    spark = with_state(events.sparkSession)
    log, out, checkpoint = (scratch_path(spark, name) for name in ("log", "jobs", "jobs-state"))
    events.write.parquet(log)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, out, number)

    def run() -> None:
        rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(log)
        result = lifecycle(rows.withColumn(key, F.coalesce(F.col(key), F.lit(_CLOCK))).withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), key, late)
        result.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    run()
    tick = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + F.lit(_micros(late)))
    events.limit(0).unionByName(spark.range(1).select(tick.cast(events.schema["ts"].dataType).alias("ts")), allowMissingColumns=True).write.mode("append").parquet(log)
    run()
    rows = spark.read.schema(f"{key} {dict(events.dtypes)[key]}, seq long, status string, attempts long, resumed long, batch long").parquet(out).filter(F.col(key) != _CLOCK)
    latest = F.max_by(F.struct("seq", "status", "attempts", "resumed"), F.struct("seq", "resumed", "batch")).alias("j")
    return rows.groupBy(key).agg(latest).select(key, "j.*")


#: The key of rows that only tell the time.
_CLOCK = -1


def _micros(late: str) -> int:
    number, unit = late.split()
    if not unit.startswith("day"):
        raise ValueError("late is a number of days")
    return int(number) * 86_400_000_000
