"""The semantic answer cache as a state processor: nearest stored vector, time to live, least recently used out first.

A key is a version of the pipeline and a slot of it (any column that spreads a version's requests, such as a hash of their cell; requests of different slots do not share answers). Its entries are a map
in the state store, at most ``most`` of them, so a key's state is bounded; requests pass through in the batches they come in and are never held together.

A request drops the entries not used for longer than the time to live, then takes the answer of the most similar entry (then the oldest) if that is similar enough, which renews it; else its own answer is stored,
and the least recently used entry goes if there are too many. With ``forget`` a timer drops idle entries of keys that get no more requests, by processing time.

Requests are served in the order in which they arrive, those of a batch by time and id; the clock of a key never goes back, so a late request counts as made now. A key's requests of one batch are
sorted in its task, so a batch should be bounded, by the source's trigger options or, for stored requests, by ``arrivals``.

Cases: a request without a vector, or with a zero one, is a miss and is not stored. Vectors of another length than an entry's are not similar to it. State survives restarts by the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.sources.storage import settle

THRESHOLD, TTL_MS, MOST = 0.92, 86_400_000, 1000
SLICE_ROWS, FRAME_ROWS = 1_000_000, 10_000
OUTPUT = "version string, slot long, id long, at long, hit boolean, matched long, similarity double, answer string, expired int, evicted int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that processors need, for the queries started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Cache:
    """The entries of a key while its requests pass: id to (vector of length one, answer, last use, turn), the least recently used first. Turns number the uses of a key, as several may share a time."""

    def __init__(self, entries: dict[int, tuple], clock: int, ttl: int, most: int, threshold: float):
        self.entries = dict(sorted(entries.items(), key=lambda e: e[1][3]))
        self.turn = max((e[3] for e in entries.values()), default=0)
        self.clock, self.ttl, self.most, self.threshold = clock, ttl, most, threshold
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def _drop(self, entry: int) -> None:
        del self.entries[entry]
        self.changed.discard(entry)
        self.gone.add(entry)

    def expire(self) -> int:
        old = []
        for entry, (_, _, used, _) in self.entries.items():
            if self.clock - used <= self.ttl:
                break
            old.append(entry)
        for entry in old:
            self._drop(entry)
        return len(old)

    def nearest(self, vector: np.ndarray) -> tuple[int | None, float | None]:
        best: tuple[float, int] | None = None
        for entry, (stored, _, _, _) in self.entries.items():
            if len(stored) == len(vector):
                similarity = round(float(stored @ vector), 9)
                if similarity >= self.threshold and (best is None or (-similarity, entry) < best):
                    best = (-similarity, entry)
        return (best[1], -best[0]) if best else (None, None)

    def _use(self, entry: int, vector: np.ndarray, answer: str | None) -> None:
        self.entries.pop(entry, None)
        self.turn += 1
        self.entries[entry] = (vector, answer, self.clock, self.turn)
        self.changed.add(entry)
        self.gone.discard(entry)

    def request(self, entry: int, at: int, vector, answer: str | None) -> tuple:
        """(hit, matched, similarity, answer, expired, evicted)"""
        self.clock = max(self.clock, at)
        expired = self.expire()
        v = np.asarray(vector if vector is not None else [], np.float64)
        length = float(np.sqrt(v @ v))
        if not length > 0:
            return False, None, None, answer, expired, 0
        v = v / length
        matched, similarity = self.nearest(v)
        if matched is not None:
            stored, kept, _, _ = self.entries[matched]
            self._use(matched, stored, kept)
            return True, matched, similarity, kept, expired, 0
        self._use(entry, v, answer)
        evicted = 0
        while len(self.entries) > self.most:
            self._drop(next(iter(self.entries)))
            evicted += 1
        return False, None, None, answer, expired, evicted


class CacheProcessor(StatefulProcessor):
    def __init__(self, ttl_ms: int, most: int, threshold: float, forget: bool):
        self.ttl, self.most, self.threshold, self.forget = ttl_ms, most, threshold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("entries", "entry long", "vector array<double>, answer string, used long, turn long")
        self.clock = handle.getValueState("clock", "at long, touched long")

    def _cache(self) -> Cache:
        entries = {k[0]: (np.array(v[0], np.float64), v[1], v[2], v[3]) for k, v in self.stored.iterator()}
        clock = self.clock.get()
        return Cache(entries, clock[0] if clock else -(1 << 62), self.ttl, self.most, self.threshold)

    def _save(self, cache: Cache, touched: int) -> None:
        for entry in cache.gone:
            if self.stored.containsKey((entry,)):
                self.stored.removeKey((entry,))
        for entry in cache.changed:
            vector, answer, used, turn = cache.entries[entry]
            self.stored.updateValue((entry,), (vector.tolist(), answer, int(used), turn))
        self.clock.update((int(cache.clock), touched))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = self._cache()
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        requests = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"], kind="stable")  # frames come in no order
        for start in range(0, len(requests), FRAME_ROWS):
            frame = requests.iloc[start : start + FRAME_ROWS]
            out = [(key[0], key[1], int(i), int(at), *cache.request(int(i), int(at), vector, answer)) for i, at, vector, answer in zip(frame["id"], frame["at"], frame["vector"], frame["answer"], strict=True)]
            yield pd.DataFrame(out, columns=names).astype({"matched": "Int64", "similarity": "float64"})
        now = timerValues.getCurrentProcessingTimeInMs() if self.forget else 0
        self._save(cache, now)
        if self.forget:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No request has come for a time to live, so every entry of the key is older."""
        clock = self.clock.get()
        if clock and timerValues.getCurrentProcessingTimeInMs() - clock[1] >= self.ttl:
            self.stored.clear()
        return iter([])

    def close(self) -> None:
        pass


def serve(requests: DataFrame, ttl_ms: int = TTL_MS, most: int = MOST, threshold: float = THRESHOLD, forget: bool = True) -> DataFrame:
    """requests (version, slot, id, at, vector, answer) to OUTPUT. Start the stream inside ``state_store``. A run over what is available goes without ``forget``."""
    asked = requests.selectExpr("version", "cast(slot AS long) AS slot", "cast(id AS long) AS id", "cast(at AS long) AS at", "cast(vector AS array<double>) AS vector", "answer")
    return asked.groupBy("version", "slot").transformWithStateInPandas(CacheProcessor(ttl_ms, most, threshold, forget), OUTPUT, "Append", "ProcessingTime" if forget else "None")


def arrivals(requests: DataFrame, most: int = SLICE_ROWS) -> Iterator[DataFrame]:
    """Stored requests in the order of ``at``, in slices of about ``most`` rows; those of one time come together, whatever their number."""
    n = -(-requests.count() // most)
    if n <= 1:
        yield requests
        return
    kept = settle(requests.repartitionByRange("at"), "requests")  # a slice reads its own range of files
    bounds = sorted({int(b) for b in kept.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n)})
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        slice_ = kept if high is None else kept.where((F.col("at") < high) | F.col("at").isNull() if low is None else F.col("at") < high)
        yield slice_ if low is None else slice_.where(F.col("at") >= low)
