"""Calls of a model service from tasks: a bounded number in flight, time limits, a retry budget, and a status row for each kind of failure.

A task keeps up to ``in_flight`` calls open over its Arrow batches and hands rows on as batches end, so it holds one batch of requests. A call gets its number of the attempt and its time limit; failures that may pass
(time-outs, unreachable service, answers of 500 and above) are tried again while the row has retries and the task's budget lasts. A failed call is a row, never a failed job; a lost executor repeats
its task's calls, so calls should be safe to repeat.

Cases: a null request is not sent (status ``empty``). Every row gives one row, whatever its id. A call that does not come back within twice its time limit is left alone and keeps its slot; if no slot is left, the task's other
rows are ``stalled``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "query_id long, reply string, status string, attempts int, error string"
PASSING = frozenset(("timeout", "unreachable", "unavailable"))


class Rejected(Exception):
    """An answer that says no, with its HTTP status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def status_of(error: Exception) -> str:
    """timeout, unreachable, unavailable (500 and above), rejected (other answers), malformed (not a reply), or failed."""
    if isinstance(error, TimeoutError):
        return "timeout"
    if isinstance(error, Rejected):
        return "unavailable" if error.status >= 500 else "rejected"
    if isinstance(error, OSError):
        return "unreachable"
    return "malformed" if isinstance(error, ValueError) else "failed"


class _Calls:
    """The calls of a task."""

    def __init__(self, call: Callable[[str, int, float], str], in_flight: int, limit: float, retries: int, budget: int, pause: float):
        self.call, self.limit, self.retries, self.budget, self.pause = call, limit, retries, budget, pause
        self.pool, self.slots = ThreadPoolExecutor(in_flight), in_flight

    def _try(self, request: str, attempt: int):
        try:
            reply = self.call(request, attempt, self.limit)
            return (reply, "ok", None) if isinstance(reply, str) else (None, "malformed", f"reply is {type(reply).__name__}")
        except Exception as error:  # a status row
            return None, status_of(error), f"{type(error).__name__}: {error}"

    def run(self, requests: list[str | None]) -> list[tuple]:
        """(reply, status, attempts, error) of each request."""
        out: list[tuple] = [(None, "empty", 0, None)] * len(requests)
        waiting = [(i, 1) for i, r in enumerate(requests) if r is not None][::-1]
        held: list[tuple[float, int, int]] = []  # retries that pause until a time
        open_calls: dict[Future, tuple[int, int, float]] = {}
        while waiting or held or open_calls:
            now = time.monotonic()
            for x in [x for x in held if x[0] <= now]:
                held.remove(x)
                waiting.append(x[1:])
            while waiting and len(open_calls) < self.slots:
                i, attempt = waiting.pop()
                open_calls[self.pool.submit(self._try, requests[i], attempt)] = (i, attempt, now)
            if not open_calls and not held:  # every slot is lost
                for i, attempt in waiting:
                    out[i] = (None, "stalled", attempt - 1, "no slot is left")
                break
            done, _ = wait(open_calls, timeout=0.05 if held else self.limit / 4, return_when=FIRST_COMPLETED) if open_calls else (set(), None)
            if not open_calls:
                time.sleep(max(0.0, min(x[0] for x in held) - time.monotonic()))
            for future in list(open_calls):
                i, attempt, since = open_calls[future]
                if future in done:
                    reply, status, error = future.result()
                elif time.monotonic() - since > 2 * self.limit:
                    reply, status, error, self.slots = None, "timeout", "no answer", self.slots - 1
                else:
                    continue
                del open_calls[future]
                if status in PASSING and attempt <= self.retries and self.budget > 0:
                    self.budget -= 1
                    held.append((time.monotonic() + self.pause * attempt, i, attempt + 1))
                else:
                    out[i] = (reply, status, attempt, error)
        return out

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


def call_model(requests: DataFrame, call: Callable[[str, int, float], str], in_flight: int = 8, limit: float = 30.0, retries: int = 2, budget: int = 1000, pause: float = 0.5) -> DataFrame:
    """SCHEMA of requests (query_id, request). ``call(request, attempt, seconds)`` returns a reply or raises; ``budget``: retries a task may make."""
    if in_flight < 1 or limit <= 0 or retries < 0 or budget < 0:
        raise ValueError("calls need a slot, a time limit, and no negative retries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = _Calls(call, in_flight, limit, retries, budget, pause)
        try:
            for batch in batches:
                made = calls.run(batch.column(1).to_pylist())
                columns = [batch.column(0), *(pa.array([r[k] for r in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "reply", "status", "attempts", "error"])
        finally:
            calls.close()

    return requests.select(F.col("query_id").cast("long"), F.col("request").cast("string")).mapInArrow(run, SCHEMA)


def summary(called: DataFrame) -> DataFrame:
    """Per status: calls, attempts and rows that were tried more than once."""
    return called.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("attempts").alias("attempts"), F.count_if(F.col("attempts") > 1).alias("retried"))
