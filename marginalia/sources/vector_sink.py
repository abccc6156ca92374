"""A data source that writes vectors to a store outside Spark: batches with retries, and a commit that counts what was written and what was not.

``sink(client, ...)`` makes a source for ``df.write.format``: rows (point_id, vector, payload) of a task go to the client in batches. A batch is written whole or not at all: the client's ``upsert`` takes it in one call, and a
batch that keeps failing is counted, with its errors, and left out while the others go on. Points have ids of their own, so a task that runs again writes the same points over. The tasks' counts travel in
their commit messages; ``commit`` adds them up and hands them to the client's ``finish`` once, on the driver.

Cases: vectors that are null, of another length or not finite are counted as invalid and not sent. An empty task, and an empty table, send nothing and commit zeros. A client that cannot be made fails its
task's batches, not the job.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "point_id string, vector array<float>, payload string"


@dataclass
class Written(WriterCommitMessage):
    """What a task, or all of them, wrote."""

    batches: int = 0
    batches_failed: int = 0
    points: int = 0
    points_failed: int = 0
    points_invalid: int = 0
    attempts: int = 0
    sink_errors: int = 0
    vector_bytes: int = 0
    seconds: float = 0.0
    error: str = ""

    def add(self, other: "Written") -> None:
        for f in fields(self):
            if f.name != "error":
                setattr(self, f.name, getattr(self, f.name) + getattr(other, f.name))
        self.error = self.error or other.error


def total(messages: list[Written | None]) -> Written:
    out = Written()
    for m in messages:
        if m is not None:
            out.add(m)
    return out


class _Writer(DataSourceWriter):
    def __init__(self, client: Callable, dimension: int, batch: int, retries: int, pause: float):
        self.client, self.dimension, self.batch, self.retries, self.pause = client, dimension, batch, retries, pause

    def _send(self, store, points: list[tuple], out: Written) -> None:
        began = time.monotonic()
        out.batches += 1
        for attempt in range(1, self.retries + 2):
            out.attempts += 1
            try:
                store.upsert(points)
                out.points += len(points)
                out.vector_bytes += len(points) * self.dimension * 4
                break
            except Exception as error:  # counted; the next batch goes on
                out.sink_errors += 1
                out.error = out.error or f"{type(error).__name__}: {error}"
                if attempt <= self.retries:
                    time.sleep(self.pause)
        else:
            out.batches_failed += 1
            out.points_failed += len(points)
        out.seconds += time.monotonic() - began

    def write(self, iterator: Iterator) -> Written:
        out, store, points = Written(), _Lazy(self.client), []
        for row in iterator:
            vector = row["vector"]
            if vector is None or len(vector) != self.dimension or not all(x is not None and math.isfinite(x) for x in vector):
                out.points_invalid += 1
                continue
            points.append((row["point_id"], list(vector), row["payload"]))
            if len(points) == self.batch:
                self._send(store, points, out)
                points = []
        if points:
            self._send(store, points, out)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        self.client().finish(asdict(total(messages)))

    def abort(self, messages: list[Written | None]) -> None:
        self.client().finish(asdict(total(messages)) | {"aborted": True})


class _Lazy:
    """The client, made at the first batch."""

    def __init__(self, client: Callable):
        self.make, self.made = client, None

    def upsert(self, points: list[tuple]) -> None:
        self.made = self.made or self.make()
        self.made.upsert(points)


def sink(client: Callable, dimension: int, name: str = "vectors", batch: int = 256, retries: int = 2, pause: float = 0.1) -> type[DataSource]:
    """A data source for a store. ``client()`` gives an object with ``upsert(points)``, points being (point_id, vector, payload), and ``finish(counts)``."""

    class VectorSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(client, dimension, batch, retries, pause)

    return VectorSink


def write(points: DataFrame, client: Callable, dimension: int, **settings) -> None:
    """Write points (point_id, vector, payload) to a store; the client's ``finish`` has the counts."""
    source = sink(client, dimension, **settings)
    points.sparkSession.dataSource.register(source)
    points.selectExpr("cast(point_id AS string) AS point_id", "cast(vector AS array<float>) AS vector", "cast(payload AS string) AS payload").write.format(source.name()).mode("append").save()
