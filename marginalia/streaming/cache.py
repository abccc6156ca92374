"""The answer cache as keyed state: one entry a key, forgotten after a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def serve(requests: DataFrame, ttl_ms: int, forget: bool = True) -> DataFrame:
    """requests (version, query, at, answer) to (version, query, at, hit, answer), per key in the order of ``at``.

    A request finds the stored answer if it is younger than the time to live by event time; else its own answer is stored. With
    ``forget``, as a stream that never ends needs, an idle key leaves the state by processing-time timeout; a run over what is available goes without."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        answer, stored = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values("at")
        out = []
        for r in rows.itertuples(index=False):
            at = int(r.at)
            hit = stored is not None and at - stored <= ttl_ms
            if not hit:
                answer, stored = r.answer, at
            out.append((key[0], key[1], at, hit, answer))
        state.update((answer, stored))
        if forget:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["version", "query", "at", "hit", "answer"])

    return requests.groupBy("version", "query").applyInPandasWithState(run, "version string, query string, at long, hit boolean, answer string", "answer string, stored long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
