"""The cache of a key by itself, and as the state of a stream over several batches."""

import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.sources.storage import new_folder
from marginalia.streaming import ingest, semantic_cache as S

SCHEMA = "version string, slot long, id long, at long, vector array<double>, answer string"


def plain(requests, ttl, most, threshold):
    """Every request against a plain list of entries (id, vector, answer, used), least recently used first."""
    lists, out = {}, {}
    for version, slot, i, at, vector, answer in requests:
        entries = lists.setdefault((version, slot), [])
        fresh = [e for e in entries if at - e[3] <= ttl]
        expired, entries[:] = len(entries) - len(fresh), fresh
        norm = float(np.linalg.norm(vector)) if vector else 0.0
        if not norm:
            out[i] = (False, None, answer, expired, 0)
            continue
        v = np.array(vector) / norm
        near = sorted((-round(float(e[1] @ v), 9), e[0]) for e in entries if len(e[1]) == len(v) and round(float(e[1] @ v), 9) >= threshold)
        if near:
            hit = next(e for e in entries if e[0] == near[0][1])
            entries.remove(hit)
            entries.append((*hit[:3], at))
            out[i] = (True, hit[0], hit[2], expired, 0)
        else:
            entries.append((i, v, answer, at))
            evicted = max(0, len(entries) - most)
            del entries[:evicted]
            out[i] = (False, None, answer, expired, evicted)
    return out


def made(n, seed=2):
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice((1, 5, 20, 300 if i % 40 == 0 else 3))
        vector = rng.choice((None, [], [0.0, 0.0, 0.0], [1.0, 2.0])) if rng.random() < 0.1 else [float(rng.randrange(1, 4)), float(rng.randrange(3)), float(rng.randrange(2))]
        rows.append((rng.choice("vw"), rng.randrange(2), i, at, vector, f"a{i}"))
    return rows


def test_a_stream_of_several_batches_against_a_plain_list(spark):
    rows, source, work, out = made(400), new_folder(spark, "in"), new_folder(spark, "work"), new_folder(spark, "out")
    for part in range(4):  # each run finds the state that the last one left
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        with S.state_store(spark):
            ingest.drain(S.serve(spark.readStream.schema(SCHEMA).parquet(source), 250, 6, 0.99, forget=False), work, lambda b, i: b.write.mode("append").parquet(out))
    got = {r["id"]: (r["hit"], r["matched"], r["answer"], r["expired"], r["evicted"]) for r in spark.read.parquet(out).collect()}
    want = plain(rows, 250, 6, 0.99)
    assert got == want and sum(v[0] for v in want.values()) > 50 and sum(v[3] for v in want.values()) > 5 and sum(v[4] for v in want.values()) > 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_late_request_counts_as_made_now_and_state_stays_bounded():
    cache = S.Cache({}, -(1 << 62), 100, 3, 0.9)
    for i in range(50):
        cache.request(i, i, [float(i == j) for j in range(50)], "x")
    assert len(cache.entries) == 3 and cache.gone == set(range(47)) and cache.changed == {47, 48, 49}
    assert cache.request(99, 10, [float(j == 48) for j in range(50)], "y")[:2] == (True, 48) and cache.clock == 49 and cache.entries[48][2] == 49


def test_idle_keys_are_forgotten_by_a_timer(spark):
    import time

    source, work, out = new_folder(spark, "in"), new_folder(spark, "work"), new_folder(spark, "out")
    spark.createDataFrame([("v", 0, 1, 5, [1.0], "a")], SCHEMA).coalesce(1).write.parquet(source)
    with S.state_store(spark):
        stream = S.serve(spark.readStream.schema(SCHEMA).parquet(source), 1500, 3, 0.9).writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", f"{work}/checkpoint").trigger(processingTime="300 milliseconds").start()
    try:
        deadline = time.time() + 60
        while not any(p["numInputRows"] for p in stream.recentProgress) and time.time() < deadline:
            time.sleep(0.2)
        time.sleep(5)
        spark.createDataFrame([("v", 0, 2, 5, [1.0], "b")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        while spark.read.parquet(out).where("id = 2").count() == 0 and time.time() < deadline + 60:
            time.sleep(0.5)
    finally:
        stream.stop()  # timers keep it from ever being idle
    got = {r["id"]: (r["hit"], r["answer"]) for r in spark.read.parquet(out).where(F.col("id").isNotNull()).collect()}
    assert got == {1: (False, "a"), 2: (False, "b")}  # the same vector at the same time: only the timer took the entry


def test_requests_in_no_order_in_frames_and_slices(spark):
    """Many requests share a time; frames hold a few rows of a key, in no order; the state goes from slice to slice."""
    rows = [(v, slot, i, at // 40 * 40, vector, answer) for v, slot, i, at, vector, answer in made(300, 5)]
    mixed, inbox, work, out = rows[:], new_folder(spark, "in"), new_folder(spark, "work"), new_folder(spark, "out")
    random.Random(3).shuffle(mixed)
    asked, times, before = spark.createDataFrame(mixed, SCHEMA), [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        with S.state_store(spark):
            for part in S.arrivals(asked, 100):
                times.append(part.agg(F.min("at"), F.max("at"), F.count("id")).first())
                part.write.mode("append").parquet(inbox)
                ingest.drain(S.serve(spark.readStream.schema(SCHEMA).parquet(inbox), 250, 4, 0.99, forget=False), work, lambda b, i: b.write.mode("append").parquet(out))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(times) >= 2 and all(a[1] < b[0] for a, b in zip(times, times[1:])) and sum(t[2] for t in times) == len(rows)
    got = {r["id"]: (r["hit"], r["matched"], r["answer"], r["expired"], r["evicted"]) for r in spark.read.parquet(out).collect()}
    assert got == plain(sorted(rows, key=lambda r: (r[3], r[2])), 250, 4, 0.99)


def test_entries_of_one_time_are_loaded_by_their_use():
    cache = S.Cache({}, 0, 100, 3, 0.9)
    for i, j in enumerate((0, 1, 0)):
        cache.request(i, 5, [float(j == n) for n in range(4)], "x")  # the last uses the first again
    again = S.Cache(dict(sorted(cache.entries.items())), cache.clock, 100, 2, 0.9)
    assert list(again.entries) == [1, 0] and again.request(9, 5, [0.0, 0.0, 1.0, 0.0], "y")[5] == 1 and list(again.entries) == [0, 9]
