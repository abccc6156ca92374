"""Streaming queries, run over what is available."""

from pyspark.sql import functions as F

from marginalia.plans.registry import query, table
from marginalia.sources.storage import new_folder
from marginalia.streaming import cache, ingest, logs

_WINDOWS = "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS requests, round(avg(value), 6) AS mean_latency FROM events GROUP BY ALL"


def _stream(spark, sf_dir, name):
    """The table as a stream of its files; a stream reads folders, so a table of one file is picked from its folder by name."""
    files = table(spark, sf_dir, name)
    reader = spark.readStream.schema(files.schema)
    if files.inputFiles()[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


@query(_WINDOWS)
def query_log_window(spark, sf_dir):
    return logs.windows(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query(_WINDOWS)
def query_log_stream(spark, sf_dir):
    work, last = new_folder(spark, "log"), {}

    def each(batch, batch_id):
        last["path"] = f"{work}/{batch_id}"
        batch.write.mode("overwrite").parquet(last["path"])

    ingest.drain(logs.windows(_stream(spark, sf_dir, "events")), work, each, "complete")
    return spark.read.parquet(last["path"]).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("SELECT doc_id, source, sha256(text) AS content_hash FROM documents")
def ingest_stream(spark, sf_dir):
    rows = _stream(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    return ingest.ingest(rows, new_folder(spark, "ingest"), ["doc_id"])


@query("""WITH RECURSIVE e AS (SELECT event_type AS version, user_id AS query, epoch_ms(ts) AS t FROM events), m AS (SELECT version, query, min(t) AS t FROM e GROUP BY version, query
 UNION ALL SELECT m.version, m.query, min(e.t) FROM m JOIN e ON e.version = m.version AND e.query = m.query AND e.t > m.t + 3600000 GROUP BY m.version, m.query),
n AS (SELECT version, query, count(*) AS misses FROM m GROUP BY ALL) SELECT e.version, e.query, count(*) AS requests, count(*) - max(misses) AS hits FROM e JOIN n USING (version, query) GROUP BY ALL""")
def cache_stream(spark, sf_dir):
    """Requests served from keyed state: a request within an hour of the one that stored the answer is a hit."""
    work, parts = new_folder(spark, "cache"), []
    rows = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.col("user_id").cast("string").alias("query"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("string").alias("answer"))

    def each(batch, batch_id):
        parts.append(f"{work}/{batch_id}")
        batch.write.mode("overwrite").parquet(parts[-1])

    ingest.drain(cache.serve(rows, 3_600_000, forget=False), work, each)
    return spark.read.parquet(*parts).groupBy("version", F.col("query").cast("long").alias("query")).agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


@query("""WITH RECURSIVE e AS (SELECT event_type AS version, user_id % 4 AS slot, event_id AS id, epoch_ms(ts) AS ms, cos(user_id::double) AS x, sin(user_id::double) AS y, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY epoch_ms(ts), event_id) AS n FROM events),
s(version, slot, n, id, hit, matched, expired, evicted, entries) AS (SELECT DISTINCT version, slot, 0::bigint, NULL::bigint, false, NULL::bigint, 0, 0, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, used BIGINT)[] FROM e
 UNION ALL SELECT version, slot, n, id, best IS NOT NULL, best, expired, greatest(0, len(later) - 12)::int, later[greatest(0, len(later) - 12) + 1:] FROM (
  SELECT *, CASE WHEN best IS NOT NULL THEN list_concat(list_filter(live, lambda z: z.id <> best), list_transform(list_filter(live, lambda z: z.id = best), lambda z: {'id': z.id, 'x': z.x, 'y': z.y, 'used': ms})) ELSE list_append(live, {'id': id, 'x': x, 'y': y, 'used': ms}) END AS later FROM (
   SELECT *, (list_sort(list_transform(list_filter(live, lambda z: round(z.x * x + z.y * y, 9) >= 0.999), lambda z: {'s': -round(z.x * x + z.y * y, 9), 'id': z.id})))[1].id AS best FROM (
    SELECT e.version, e.slot, e.n, e.id, e.ms, e.x, e.y, list_filter(s.entries, lambda z: e.ms - z.used <= 172800000) AS live, (len(s.entries) - len(list_filter(s.entries, lambda z: e.ms - z.used <= 172800000)))::int AS expired
    FROM s JOIN e ON e.version = s.version AND e.slot = s.slot AND e.n = s.n + 1))))
SELECT version, slot, id, hit, coalesce(matched, -1) AS matched, expired::bigint AS expired, evicted::bigint AS evicted FROM s WHERE n > 0""")
def semantic_cache_stream(spark, sf_dir):
    """Requests served from the state of a processor: hits, expiries after two days without use, evictions beyond twelve entries. A user's angle stands in for the vector of a question.

    The log comes to the stream's folder in slices, in order of time; the state goes on from one to the next."""
    from marginalia.streaming import semantic_cache

    work, inbox, parts = new_folder(spark, "semantic_cache"), new_folder(spark, "inbox"), []
    angle = F.col("user_id").cast("double")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), (F.col("user_id") % 4).alias("slot"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.array(F.cos(angle), F.sin(angle)).alias("vector"), F.lit("").alias("answer"))

    def each(batch, batch_id):
        parts.append(f"{work}/{batch_id}")
        batch.write.mode("overwrite").parquet(parts[-1])

    with semantic_cache.state_store(spark):
        for arrived in semantic_cache.arrivals(rows):
            arrived.write.mode("append").parquet(inbox)
            ingest.drain(semantic_cache.serve(spark.readStream.schema(rows.schema).parquet(inbox), 172_800_000, 12, 0.999, forget=False), work, each)
    return spark.read.parquet(*parts).select("version", "slot", "id", "hit", F.coalesce("matched", F.lit(-1)).alias("matched"), "expired", "evicted")
