"""Stores and services: comparison by digests, vector writes, model calls, chunk tables, pooling."""

from pyspark.sql import functions as F

from marginalia.plans.registry import query, table
from marginalia.plans.retrieval import vectors
from marginalia.sources.storage import new_folder

FIELDS = ["chunk_id", "note_id", "chunk_index", "chunking_version", "text", "section_title", "section_level", "section_path", "source_path", "start_offset", "end_offset"]
_CHANGED = {"note_id": 83, "text": 89, "section_title": 73, "section_level": 83, "section_path": 79, "source_path": 71, "start_offset": 67, "end_offset": 61}
_DIFFERENCES = " || ".join(f"CASE WHEN id % {n} = 0 THEN '{f},' ELSE '' END" for f, n in sorted(_CHANGED.items(), key=lambda x: FIELDS.index(x[0])))


def _chunks(spark, sf_dir):
    """Documents as chunks with the eleven fields of a point."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("k"), i.cast("string")).alias("point_key"), i.alias("chunk_id"), F.floor(i / 10).alias("note_id"), (i % 10).alias("chunk_index"), F.lit("v1").alias("chunking_version"), "text", F.col("source").alias("section_title"),
        (F.col("n_chars") % 6).alias("section_level"), F.array("source", "lang").alias("section_path"), F.concat("source", F.lit("/"), i.cast("string"), F.lit(".md")).alias("source_path"), F.lit(0).cast("long").alias("start_offset"), F.col("n_chars").alias("end_offset"),
    )


@query(f"""WITH d AS (SELECT doc_id AS id, concat('k', doc_id) AS point_key, {_DIFFERENCES} AS names FROM documents)
SELECT point_key, CASE WHEN id % 97 = 0 THEN 'missing' ELSE rtrim(names, ',') END AS difference FROM d WHERE id % 97 = 0 OR names <> '' UNION ALL SELECT concat('x', id), 'extra' FROM d WHERE id % 97 = 0""")
def store_consistency_fields(spark, sf_dir):
    """All eleven fields of chunks and points, of which some are missing, some are extra and some differ."""
    from marginalia.operators import digests

    held, i = _chunks(spark, sf_dir), F.col("chunk_id")
    other = {"text": F.concat(F.coalesce("text", F.lit("")), F.lit("+")), "section_title": F.lit(None).cast("string"), "section_path": F.array_append("section_path", F.lit("x")), "source_path": F.concat("source_path", F.lit("x"))}
    changed = {f: F.when(i % n == 0, other.get(f, F.coalesce(f, F.lit(0)) + 1)).otherwise(F.col(f)) for f, n in _CHANGED.items()}
    points = held.withColumns(changed).withColumn("point_key", F.when(i % 97 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(F.col("point_key")))
    return digests.compare(held, points, FIELDS, "point_key")[0]


@query("""SELECT count(*) FILTER (vec_id % 50 <> 0) AS points, count(*) FILTER (vec_id % 50 <> 0) AS points_reported, count(*) FILTER (vec_id % 50 = 0) AS points_invalid, 0::bigint AS points_failed, (count(*) FILTER (vec_id % 50 <> 0) * 256)::bigint AS vector_bytes, true AS each_batch_tried_twice FROM embeddings""")
def vector_sink_write(spark, sf_dir):
    """Vectors written to a folder by a client that fails each batch's first attempt; every fiftieth vector is cut short. One row: what the folder holds and what the commit reports."""
    from marginalia.sources import vector_sink

    folder = new_folder(spark, "vectors")

    def client():
        import json
        import os

        import pyarrow.fs as fs

        class Client:
            tried: set = set()
            store, path = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")

            def put(self, name, content):
                mark = f"{self.path}/{name}-{os.getpid()}.tmp"
                self.store.create_dir(f"{self.path}/{name.split('/')[0]}", recursive=True)
                with self.store.open_output_stream(mark) as f:
                    f.write(content.encode())
                self.store.move(mark, f"{self.path}/{name}")  # whole or not at all

            def upsert(self, points):
                first = points[0][0]
                if first not in self.tried:
                    self.tried.add(first)
                    raise ConnectionError("first attempt")
                self.put(f"points/{first}.json", "\n".join(json.dumps({"id": p[0], "n": len(p[1])}) for p in points))

            def finish(self, counts):
                self.put("counts/counts.json", json.dumps(counts))

        return Client()

    rows = vectors(spark, sf_dir).select(F.col("chunk_id").alias("point_id"), F.when(F.col("chunk_id") % 50 == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector")).alias("vector"), F.lit("{}").alias("payload"))
    vector_sink.write(rows, client, 64, batch=64, pause=0.0)
    held = spark.read.schema("id string, n int").json(f"{folder}/points").where("n = 64").agg(F.count_distinct("id").alias("points"))
    counts = spark.read.schema("points long, points_invalid long, points_failed long, vector_bytes long, batches long, attempts long, sink_errors long").json(f"{folder}/counts")
    reported = counts.select(F.col("points").alias("points_reported"), "points_invalid", "points_failed", "vector_bytes", ((F.col("attempts") == 2 * F.col("batches")) & (F.col("sink_errors") == F.col("batches"))).alias("each_batch_tried_twice"))
    return held.crossJoin(reported)  # one row each


@query("""SELECT doc_id AS query_id, CASE WHEN doc_id % 17 = 0 OR doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 5 = 0 THEN 'none' ELSE concat(coalesce(length(text), 0), ' characters') END AS reply,
CASE WHEN doc_id % 17 = 0 THEN 'unreachable' WHEN doc_id % 13 = 0 THEN 'rejected' WHEN doc_id % 11 = 0 THEN 'unavailable' WHEN doc_id % 5 = 0 THEN 'malformed' ELSE 'ok' END AS status,
CASE WHEN doc_id % 17 = 0 THEN 2 WHEN doc_id % 13 = 0 THEN 1 WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN 2 ELSE 1 END::bigint AS attempts FROM documents""")
def model_calls(spark, sf_dir):
    """Calls of a stand-in service that is out of reach, turns away, is overloaded, too slow once or answers badly, by the request's number."""
    from marginalia.operators import calls

    def service(request, attempt, seconds):
        i, n = (int(x) for x in request.split(":"))
        if i % 17 == 0:
            raise ConnectionError("no route")
        if i % 13 == 0:
            raise calls.Rejected(404)
        if i % 11 == 0:
            raise calls.Rejected(503)
        if i % 7 == 0 and attempt == 1:
            raise TimeoutError
        return 3 if i % 5 == 0 else f"{n} characters"

    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.length("text"), F.lit(0)).cast("string")).alias("request"))
    return calls.call_model(asked, service, retries=1, budget=1 << 40, pause=0.0).select("query_id", F.coalesce("reply", F.lit("none")).alias("reply"), "status", "attempts")


_TOKENS = "list_transform(regexp_extract_all(lower(text), '[a-z]+')[:64], lambda w: [length(w), ascii(w) - 96, (length(w) % 3) - 1]::double[])"


@query(f"""WITH t AS (SELECT doc_id, list_filter({_TOKENS}, lambda v: v[1] <> 2) AS ts FROM documents), m AS (SELECT doc_id, len(ts)::bigint AS n_tokens, list_transform([1, 2, 3], lambda k: coalesce(list_sum(list_transform(ts, lambda v: v[k] * (CASE WHEN v[1] > 6 THEN 2 ELSE 1 END))), 0)) AS s FROM t)
SELECT doc_id AS chunk_id, n_tokens, CASE WHEN n_tokens = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN n_tokens = 0 THEN -9 ELSE round(s[1] / sqrt(s[1] * s[1] + s[2] * s[2] + s[3] * s[3]), 6) END AS x, CASE WHEN n_tokens = 0 THEN -9 ELSE round(s[3] / sqrt(s[1] * s[1] + s[2] * s[2] + s[3] * s[3]), 6) END AS z FROM m""")
def pooled_encoder(spark, sf_dir):
    """Documents as token vectors of three numbers, those of words of two letters masked, those of long words twice as heavy, pooled over the first 64 tokens."""
    from marginalia.operators import pooling

    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("coalesce(regexp_extract_all(lower(text), '[a-z]+', 0), array())").alias("w"))
    tokens = F.expr("transform(w, x -> array(cast(length(x) AS double), cast(ascii(x) - 96 AS double), cast(length(x) % 3 - 1 AS double)))")
    mask = F.expr("transform(w, x -> CASE WHEN length(x) = 2 THEN 0.0D WHEN length(x) > 6 THEN 2.0D ELSE 1.0D END)")
    at = lambda k: F.coalesce(F.round(F.get("vector", F.lit(k)), 6), F.lit(-9.0))
    return pooling.pool(words.select("chunk_id", tokens.alias("tokens"), mask.alias("mask")), 3, 64).select("chunk_id", "n_tokens", "status", at(0).alias("x"), at(2).alias("z"))


@query("""WITH c AS (SELECT doc_id // 10 AS note_id, doc_id % 10 AS chunk_index, doc_id, CASE WHEN doc_id % 20 < 10 AND doc_id % 30 < 10 THEN 'again' WHEN doc_id % 20 < 10 THEN 'even' ELSE 'odd' END AS state FROM documents)
SELECT note_id, chunk_index, doc_id AS chunk_id, state, concat('note ', note_id) AS title FROM c WHERE state <> 'odd'""")
def chunk_store_scan(spark, sf_dir):
    """Two generations; of the first one, every third note is replaced; the scan joins it to its notes."""
    from uuid import uuid4

    from marginalia.sources.chunk_store import ChunkStore

    store = ChunkStore(spark, new_folder(spark, "chunk_store"), f"s{uuid4().hex}")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("note_id"), (F.col("doc_id") % 10).alias("chunk_index"), F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 20 < 10, "even").otherwise("odd").alias("state"))
    rows = rows.withColumn("chunking_version", F.when(F.col("state") == "even", "v1").otherwise("v2"))
    store.put_notes(rows.select("note_id").distinct().withColumn("title", F.concat(F.lit("note "), F.col("note_id").cast("string"))))
    store.put(rows)
    store.upsert(rows.where("state = 'even' AND note_id % 3 = 0").withColumn("state", F.lit("again")))
    return store.scan("v1").select("note_id", "chunk_index", "chunk_id", "state", "title")
