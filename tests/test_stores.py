"""Stores and services outside Spark: digests of two stores, vector sink, bounded calls, chunk store, counters of a write, pooling."""

import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import calls, digests, embedding, ingest, pooling
from marginalia.sources import chunk_store, vector_sink
from marginalia.sources.storage import new_folder


def test_digests_find_what_a_full_comparison_finds(spark):
    a = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("t"), "id").alias("text"), F.array(F.lit("x"), (F.col("id") % 3).cast("string")).alias("path"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("level"))
    i = F.col("chunk_id")
    b = a.where("chunk_id <> 7").withColumns({"text": F.when(i == 11, "").otherwise(F.col("text")), "level": F.when(i == 10, 0).when(i == 12, None).otherwise(F.col("level")), "path": F.when(i == 13, F.reverse("path")).otherwise(F.col("path"))})
    b = b.unionByName(a.where("chunk_id = 5").withColumn("chunk_id", F.lit(-5).cast("long"))).unionByName(a.where("chunk_id = 6").withColumn("chunk_id", F.lit(None).cast("long")))
    fields = ["text", "path", "level"]
    rows, read = digests.compare(a, b, fields)
    got = {r["chunk_id"]: r["difference"] for r in rows.collect()}
    assert got == {7: "missing", 11: "text", 10: "level", 12: "level", 13: "path", -5: "extra", None: "extra"}
    assert {k: v for k, v in got.items() if k is not None} == {r["chunk_id"]: r["difference"] for r in embedding.consistency(a, b.where("chunk_id IS NOT NULL"), fields).collect()}
    assert read["different"] <= 7 and read["rows"] < 40 and read["all"] == 3000 + 3001
    rows, read = digests.compare(a, a, fields)
    assert rows.count() == 0 and read["different"] == 0 and read["rows"] == 0
    twice = a.unionByName(a.where("chunk_id IN (1, 2)"))
    assert {r["chunk_id"] for r in digests.compare(a, twice, fields)[0].collect()} == {1, 2}
    assert digests.compare(a.limit(0), a.limit(0), fields)[0].count() == 0


def flaky(folder, fails):
    """A client that keeps points as files; ``fails(points, attempt)`` says when a call breaks."""

    class Client:
        tries: dict = {}

        def upsert(self, points):
            key = points[0][0]
            self.tries[key] = self.tries.get(key, 0) + 1
            if fails(points, self.tries[key]):
                raise ConnectionError(f"no store for {key}")
            with open(f"{folder}/{key}.tmp", "w") as f:
                json.dump(points, f)
            os.replace(f"{folder}/{key}.tmp", f"{folder}/{key}.json")

        def finish(self, counts):
            with open(f"{folder}/counts", "w") as f:
                json.dump(counts, f)

    return Client


def stored(folder):
    return sorted(p[0] for f in os.listdir(folder) if f.endswith(".json") for p in json.load(open(f"{folder}/{f}"))), json.load(open(f"{folder}/counts"))


def test_a_failing_batch_is_counted_and_leaves_no_half(spark, tmp_path):
    points = spark.range(100).select(F.format_string("p%03d", "id").alias("point_id"), F.when(F.col("id") != 50, F.array(*[F.col("id").cast("float") for _ in range(4)])).alias("vector"), F.lit("{}").alias("payload")).coalesce(1)
    folder = str(tmp_path)
    vector_sink.write(points, flaky(folder, lambda p, n: n == 1 or any(x[0] == "p015" for x in p)), 4, batch=10, retries=2, pause=0.0)
    ids, counts = stored(folder)
    assert ids == [f"p{i:03d}" for i in range(100) if i != 50 and not 10 <= i < 20]  # the whole batch of p015 is missing
    assert counts["batches"] == 10 and counts["batches_failed"] == 1 and counts["points"] == 89 and counts["points_failed"] == 10 and counts["points_invalid"] == 1
    assert counts["attempts"] == 9 * 2 + 3 and counts["sink_errors"] == 9 + 3 and counts["vector_bytes"] == 89 * 16 and "no store" in counts["error"]


def test_sink_over_several_tasks_and_empty_tables(spark, tmp_path):
    points = spark.range(1000).select(F.format_string("p%04d", "id").alias("point_id"), F.array(F.lit(1.0)).alias("vector"), F.lit(None).cast("string").alias("payload")).repartition(7)
    folder = str(tmp_path)
    for _ in range(2):  # points have ids, so a second write changes nothing
        vector_sink.write(points, flaky(folder, lambda p, n: False), 1, name="second", batch=64)
    ids, counts = stored(folder)
    assert sorted(set(ids)) == [f"p{i:04d}" for i in range(1000)] and counts["points"] == 1000 and counts["sink_errors"] == 0
    vector_sink.write(points.limit(0), flaky(folder, lambda p, n: False), 1, name="third")
    assert stored(folder)[1]["points"] == 0


def test_a_client_that_cannot_be_made(spark, tmp_path):
    folder, made = str(tmp_path), flaky(str(tmp_path), lambda p, n: False)

    def client(driver=os.getpid()):
        import inspect

        if any(f.function == "upsert" for f in inspect.stack()):
            raise OSError("no route")
        return made()

    vector_sink.write(spark.range(5).select(F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("vector"), F.lit("").alias("payload")).coalesce(1), client, 1, name="fourth", retries=1, pause=0.0)
    counts = stored(folder)[1]
    assert counts["points"] == 0 and counts["points_failed"] == 5 and counts["sink_errors"] == 2


def service():
    def model(request, attempt, seconds):
        kind, _, i = request.partition(" ")
        if kind == "slow":
            raise TimeoutError("too slow")
        if kind == "gone":
            raise ConnectionError("refused")
        if kind == "later" and attempt < 3:
            raise calls.Rejected(503)
        if kind == "no":
            raise calls.Rejected(404, "no such model")
        if kind == "odd":
            return 5
        if kind == "bug":
            raise KeyError("x")
        if kind == "bad":
            raise ValueError("no JSON")
        time.sleep(0.002 * (int(i) % 5))
        return f"{kind} {i} {attempt}"

    return model


def test_calls_give_a_row_for_each_kind_of_failure(spark):
    kinds = ["fine", "slow", "gone", "later", "no", "odd", "bug", "bad", None]
    rows = [(i, f"{kinds[i % 9]} {i}" if kinds[i % 9] else None) for i in range(180)]
    df = spark.createDataFrame(rows + [(None, "fine 3"), (0, "fine 0")], "query_id long, request string")
    want = {"fine": ("ok", 1), "slow": ("timeout", 3), "gone": ("unreachable", 3), "later": ("ok", 3), "no": ("rejected", 1), "odd": ("malformed", 1), "bug": ("failed", 1), "bad": ("malformed", 1), None: ("empty", 0)}
    for parts, in_flight in ((1, 8), (5, 1)):
        got = calls.call_model(df.repartition(parts), service(), in_flight=in_flight, retries=2, pause=0.001).collect()
        assert len(got) == 182
        for r in got:
            if r["query_id"]:
                kind = kinds[r["query_id"] % 9]
                assert (r["status"], r["attempts"]) == want[kind] and (r["reply"] is None) == (r["status"] != "ok")
                if r["status"] == "ok":
                    assert r["reply"] == f"{kind} {r['query_id']} {r['attempts']}"
    by = {r["status"]: r["rows"] for r in calls.summary(calls.call_model(df.coalesce(1), service(), budget=0)).collect()}
    assert by["unavailable"] == 20 and by["ok"] == 22  # no retries are left to pay for


def test_calls_in_flight_are_bounded_and_a_stuck_call_costs_its_slot():
    now, most, lock = [0], [0], threading.Lock()

    def call(request, attempt, seconds):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return request

    run = calls._Calls(call, 4, 5.0, 0, 0, 0.0)
    assert [r[0] for r in run.run([str(i) for i in range(40)])] == [str(i) for i in range(40)] and most[0] == 4
    release = threading.Event()
    stuck = calls._Calls(lambda r, a, s: release.wait(20) and r, 2, 0.1, 0, 0, 0.0)
    got = stuck.run(["a", "b", "c"])
    assert [(r[1], r[2]) for r in got] == [("timeout", 1), ("timeout", 1), ("stalled", 0)]
    release.set()
    for wrong in ({"in_flight": 0}, {"limit": 0}, {"retries": -1}):
        with pytest.raises(ValueError):
            calls.call_model(None, service(), **wrong)


def test_chunk_store(spark, tmp_path):
    store = chunk_store.ChunkStore(spark, str(tmp_path), "store_test", 4)
    notes = spark.range(40).select(F.col("id").alias("note_id"), F.concat(F.lit("note "), "id").alias("title"))
    rows = lambda version, text, upto=40: spark.range(upto * 3).select((F.col("id") % upto).alias("note_id"), (F.col("id") / upto).cast("int").alias("chunk_index"), F.lit(version).alias("chunking_version"), F.concat(F.lit(text), "id").alias("text"))

    def files(version):
        folder = tmp_path / "store_test_chunks" / f"chunking_version={version}"
        return {f.name: f.read_bytes() for f in folder.iterdir() if f.name.endswith(".parquet")} if folder.exists() else {}

    try:
        store.put_notes(notes)
        store.put(rows("v1", "a"))
        before = files("v1")
        store.put(rows("v2", "b"))
        assert files("v1") == before and len(before) == 4  # byte by byte, a file a bucket
        found = store.scan("v2")
        found.collect()
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        got = [(r["note_id"], r["chunk_index"], r["text"], r["title"]) for r in found.collect()]
        assert sorted(got) == sorted((i % 40, i // 40, f"b{i}", f"note {i % 40}") for i in range(120))
        for part in found.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.collect_list(F.struct("note_id", "chunk_index")).alias("l")).collect():
            assert part["l"] == sorted(part["l"])
        store.put(rows("v2", "c", 10))
        assert files("v1") == before and store.scan("v2").count() == 30
        store.upsert(rows("v2", "d", 2).where("note_id = 1"))
        texts = {(r["note_id"], r["chunk_index"]): r["text"] for r in store.scan("v2").collect()}
        assert len(texts) == 30 and texts[1, 2] == "d5" and texts[2, 2] == "c22" and files("v1") == before
        store.put(rows("v3", "e").limit(0))
        store.delete("v2")
        assert store.scan("v2").count() == 0 and files("v2") == {} and files("v1") == before and store.scan("v1").count() == 120
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {store.chunks}")
        spark.sql(f"DROP TABLE IF EXISTS {store.notes}")
    with pytest.raises(ValueError):
        chunk_store.ChunkStore(spark, "x", "bad name")


@pytest.mark.parametrize("statuses,want", [(["new", "changed", "unchanged", "unchanged", "failed", "stale"], (5, 1, 1, 2, 1, 1, 0.8, 4, 2, "partial")), (["new"], (1, 1, 0, 0, 0, 0, 1.0, 1, 0, "completed")), (["failed", "stale"], (1, 0, 0, 0, 1, 1, 0.0, 0, 0, "failed")), ([], (0, 0, 0, 0, 0, 0, 0.0, 0, 0, "completed"))])
def test_a_write_counts_its_states(spark, tmp_path, statuses, want):
    states = spark.createDataFrame([(f"n{i}", s, 3) for i, s in enumerate(statuses)], "relative_path string, status string, run_id long")
    row = ingest.store_states(states, str(tmp_path), 3, "all").first()
    assert tuple(row) == (3, "all", *want)
    assert spark.read.schema("relative_path string, status string, run_id long").parquet(str(tmp_path)).count() == len(statuses)


def test_pooling_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 9))
        tokens = [[float(v) for v in rng.integers(-3, 4, 3)] for _ in range(n)]
        mask = None if i % 7 == 0 else [float(m) for m in rng.choice([0, 1, 1, 2], n)]
        rows.append((i, None if i == 5 else tokens, mask))
    rows += [(100, [[1.0, 2.0]], [1.0]), (101, [[1.0, 2.0, 3.0]], [1.0, 1.0]), (102, [[1.0, float("nan"), 3.0]], None), (103, [[1.0, None, 3.0]], None), (104, [[0.0, 0.0, 0.0]], None), (105, [[3.0, 0.0, 4.0]] * 4 + [[9.0, 9.0]], None), (None, [[0.0, 2.0, 0.0]], None), (106, [[1.0, 1.0, 1.0], None], [1.0, 0.0])]
    want = {}
    for i, tokens, mask in rows:
        pairs = list(zip(tokens or [], mask if mask is not None else [1.0] * len(tokens or [])))[:4]
        used = [(t, m) for t, m in pairs if m]
        if mask is not None and len(mask) != len(tokens or []) or any(t is None or len(t) != 3 or any(v is None or v != v for v in t) for t, _ in used):
            want[i] = ("invalid", None)
        elif not used:
            want[i] = ("empty", None)
        else:
            mean = sum(np.array(t) * m for t, m in used) / sum(m for _, m in used)
            norm = np.sqrt((mean**2).sum())
            want[i] = ("ok", mean / norm if norm else mean)
    got = pooling.pool(spark.createDataFrame(rows, "chunk_id long, tokens array<array<double>>, mask array<double>").repartition(3), 3, 4).collect()
    assert len(got) == len(rows)
    for r in got:
        status, vector = want[r["chunk_id"]]
        assert r["status"] == status, r
        assert (r["vector"] is None) == (vector is None) and (vector is None or np.allclose(r["vector"], vector))
