"""State machines over ordered events: adaptive concurrency, key rings, retries and the life of a job.

The events of a key are read in order by one task, a batch at a time, with a state of a few numbers: a key may have
any number of events. Each machine is a step from state and event to state and result.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

COOLDOWN_MS, BENCH_MS, MAX_ATTEMPTS, RETRY_BASE_S, REJECTED_LIMIT, SUBMIT_ATTEMPTS = 10_000, 600_000, 3, 20, 6, 8


def values(column: pa.Array) -> list:
    """to_pylist(), by way of numpy where that gives the same objects, which is several times as fast."""
    kind = column.type
    plain = pa.types.is_string(kind) or (column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def fold(events: DataFrame, key: str | list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], out: str) -> DataFrame:
    """Rows key, order and the results of step (named and typed by out) for each event, the state starting anew for each key.

    step changes the state in place. It gets the event as a named tuple. Batches are read as Arrow has them, so nulls are
    None and keys of any size stay what they are; null is a key too.
    """
    keys = [key] if isinstance(key, str) else key
    through, made = [*keys, *order], StructType.fromDDL(out)
    kinds, key_of = to_arrow_schema(made), itemgetter(*[events.columns.index(k) for k in keys])
    Event = namedtuple("Event", events.columns, rename=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, start()
        for got in batches:
            rows = []
            for e in map(Event._make, zip(*map(values, got.columns), strict=True)):
                if (now := key_of(e)) != here:
                    here, state = now, start()
                rows.append(step(state, e))
            results = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(got.column(c) for c in through), *(pa.array(c, f.type) for c, f in zip(results, kinds, strict=True))], [*through, *kinds.names])

    schema = StructType([*events.select(*through).schema.fields, *made.fields])
    return events.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def concurrency(events: DataFrame, key: str, order: list[str], configured: int) -> DataFrame:
    """current: how many requests run at once after each event (t_ms, outcome "ok" or "rate_limited").

    A rate limit halves it, once in ten seconds at most; as many successes as there run, four at least, raise it by a
    quarter, up to what is configured.
    """

    def step(s: dict, e: tuple) -> tuple:
        if e.outcome == "rate_limited":
            if s["cut"] is None or e.t_ms - s["cut"] >= COOLDOWN_MS:
                s.update(cut=e.t_ms, now=max(1, s["now"] // 2), good=0)
        elif s["now"] >= configured:
            s["good"] = 0
        else:
            s["good"] += 1
            if s["good"] >= max(s["now"], 4):
                s.update(good=0, now=min(configured, s["now"] + max(1, s["now"] // 4)))
        return (s["now"],)

    return fold(events, key, order, lambda: {"now": configured, "good": 0, "cut": None}, step, "current long")


def key_ring(events: DataFrame, key: str, order: list[str], keys: int) -> DataFrame:
    """picked: which of a number of keys serves each request (t_ms, outcome "ok" or "credential"), from 0; -1 for none.

    Keys take turns among the usable ones; one that is refused rests for ten minutes, unless it is the only one.
    """

    def step(s: dict, e: tuple) -> tuple:
        usable = [k for k in range(keys) if s["rests"].get(k, 0) <= e.t_ms]
        if not usable:
            return (-1,)
        at = s["next"] % len(usable)
        s["next"] = at + 1
        if e.outcome == "credential" and keys > 1:
            s["rests"][usable[at]] = e.t_ms + BENCH_MS
        return (usable[at],)

    return fold(events, key, order, lambda: {"next": 0, "rests": {}}, step, "picked long")


def retry_ladder(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What follows each attempt (kind, null for a success; retry_after_ms): decision, wait_ms.

    Transient errors and rate limits are tried again, up to eight times for a request; a refused request is given up,
    and six such in a row end the document, as do credential and fatal errors.
    """

    def step(s: dict, e: tuple) -> tuple:
        if s["over"]:
            return "skipped", None
        s["try"] += 1
        kind = e.kind
        if kind is None:
            s.update({"try": 0, "rejected": 0})
            return "done", None
        if kind in ("fatal", "credential"):
            s["over"] = True
            return "document ends", None
        if kind in ("rejected", "oversized", "refused"):
            s["rejected"] += kind == "rejected"
            s.update({"try": 0, "over": s["rejected"] >= REJECTED_LIMIT})
            return "document ends" if s["over"] else "given up", None
        if s["try"] >= SUBMIT_ATTEMPTS:
            s["over"] = True
            return "document ends", None
        base = min(2 ** (s["try"] - 1), 32) * 1000
        asked = base if e.retry_after_ms is None else e.retry_after_ms
        return "retry", float(max(asked, base / 2))

    return fold(attempts, key, order, lambda: {"try": 0, "rejected": 0, "over": False}, step, "decision string, wait_ms double")


def job_step(s: dict, outcome: str, permanent: bool, t_ms: int) -> None:
    """One event in the life of a job: start, done, error, cancel or recover; what doesn't fit its status changes nothing.

    Work that is done counts even if the job was cancelled meanwhile.
    """
    if outcome == "start" and (s["status"] == "queued" or s["status"] == "retrying" and s["due"] <= t_ms):
        s["status"] = "processing"
    elif outcome == "done" and s["status"] in ("processing", "cancelled"):
        s["status"] = "completed"
    elif outcome == "cancel" and s["status"] in ("queued", "processing", "retrying"):
        s["status"] = "cancelled"
    elif outcome == "recover" and s["status"] in ("processing", "retrying"):
        s["status"] = "queued"
    elif outcome == "error" and s["status"] == "processing":
        again = not permanent and s["attempts"] + 1 < MAX_ATTEMPTS
        s["attempts"] += 1
        s["status"], s["due"] = ("retrying", t_ms + RETRY_BASE_S * s["attempts"] * 1000) if again else ("failed", 0)


def job_lifecycle(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """status and attempts of a job after each event (t_ms, outcome, permanent)."""

    def step(s: dict, e: tuple) -> tuple:
        job_step(s, e.outcome, bool(e.permanent), e.t_ms)
        return s["status"], s["attempts"]

    return fold(events, key, order, lambda: {"status": "queued", "attempts": 0, "due": 0}, step, "status string, attempts long")
