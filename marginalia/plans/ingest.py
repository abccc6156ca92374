"""Ingestion over two snapshots of the documents."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import ingest as G, markdown as M
from marginalia.plans.registry import NOTES_SQL, notes, query, table

_SNAP = """inc AS (SELECT concat(source, '/', doc_id, '.md') AS relative_path, sha256(text) AS content_hash, CASE WHEN doc_id % 10 = 4 THEN 'failed' ELSE 'parsed' END AS parse_status, 'p1' AS parser_version, source FROM documents WHERE doc_id % 10 <> 5),
prev AS (SELECT concat(source, '/', doc_id, '.md') AS relative_path, CASE WHEN doc_id % 10 = 1 THEN 'old' ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 10 = 2 THEN 'p0' ELSE 'p1' END AS parser_version, CASE WHEN doc_id % 10 = 3 THEN 'failed' ELSE 'unchanged' END AS last_status FROM documents WHERE doc_id % 10 <> 0),
dec AS (SELECT inc.relative_path, CASE WHEN parse_status <> 'parsed' THEN 'failed' WHEN prev.relative_path IS NULL THEN 'new' WHEN last_status = 'failed' THEN 'changed' WHEN inc.content_hash = prev.content_hash AND inc.parser_version = prev.parser_version THEN 'unchanged' ELSE 'changed' END AS decision,
 CASE WHEN parse_status <> 'parsed' THEN 'incoming_note_failed_to_parse' WHEN prev.relative_path IS NULL THEN 'no_persisted_note_at_relative_path' WHEN last_status = 'failed' THEN 'previous_attempt_failed_and_requires_retry' WHEN inc.content_hash = prev.content_hash AND inc.parser_version = prev.parser_version THEN 'content_and_parser_version_match' ELSE 'content_or_parser_version_changed' END AS reason FROM inc LEFT JOIN prev USING (relative_path)),
stale AS (SELECT relative_path FROM prev WHERE relative_path NOT IN (SELECT relative_path FROM inc))"""


def _snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), T.content_hash(F.col("text")).alias("content_hash"))
    mod = F.col("doc_id") % 10
    new = G.incoming(d.where(mod != 5).withColumn("status", F.when(mod == 4, "malformed_frontmatter").otherwise("ok")).withColumn("parser_version", F.lit("p1")))
    old = d.where(mod != 0).select("relative_path", F.when(mod == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(mod == 2, "p0").otherwise("p1").alias("parser_version"), F.when(mod == 3, "failed").otherwise("unchanged").alias("last_status"))
    return new, old


@query(f"WITH {_SNAP} SELECT relative_path, decision, reason, decision IN ('new', 'changed') AS should_process FROM dec")
def ingest_decision(spark, sf_dir):
    return G.decide(*_snapshots(spark, sf_dir)).select("relative_path", "decision", "reason", "should_process")


@query(f"WITH {_SNAP} SELECT relative_path FROM stale")
def ingest_stale(spark, sf_dir):
    return G.stale(*_snapshots(spark, sf_dir)).select("relative_path")


_COUNTERS = _SNAP + ", c AS (SELECT count(*) AS total, " + ", ".join(f"count_if(decision = '{k}')::bigint AS \"{k}\"" for k in ("new", "changed", "unchanged", "failed")) + ", (SELECT count(*) FROM stale) AS stale FROM dec)"


@query(f"WITH {_COUNTERS} SELECT total, \"new\", changed, unchanged, failed, stale FROM c")
def ingest_counters(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return G.counters(G.decide(new, old), G.stale(new, old)).select("total", "new", "changed", "unchanged", "failed", "stale")


@query(f"WITH {_COUNTERS} SELECT round((\"new\" + changed + unchanged) / total, 6) AS success_rate, \"new\" + changed + unchanged AS succeeded, unchanged AS skipped, CASE WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM c")
def run_metrics(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return G.counters(G.decide(new, old), G.stale(new, old)).select("success_rate", "succeeded", "skipped", "status")


@query(f"WITH {_SNAP} SELECT relative_path, decision AS status, 1::bigint AS run_id FROM dec UNION ALL SELECT relative_path, 'stale', 1 FROM stale")
def run_states(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    return G.states(G.decide(new, old), G.stale(new, old), 1).select("relative_path", "status", "run_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_state(spark, sf_dir):
    return G.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT 'labels' AS relation, count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def audit_orphans(spark, sf_dir):
    """Children whose parent is gone; every seventh parent is taken away."""
    docs, customers = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0"), table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    parts = [("labels", G.orphans(table(spark, sf_dir, "labels"), docs, "doc_id", "doc_id")), ("orders", G.orphans(table(spark, sf_dir, "orders"), customers, "o_custkey", "c_custkey"))]
    a, b = (rows.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("relation"), "orphans") for name, rows in parts)
    return a.unionByName(b)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def audit_duplicates(spark, sf_dir):
    return G.repeated(table(spark, sf_dir, "events"), "user_id", "event_type")


def _links(spark, sf_dir):
    return M.links(M.lines(notes(spark, sf_dir)))


@query("SELECT doc_id AS note_id, concat(source, '/', doc_id + 1) AS target, coalesce(p.n, t.n, -1) AS target_note_id FROM documents d LEFT JOIN (SELECT lower(concat(source, '/', doc_id)) AS k, max(doc_id) AS n FROM documents GROUP BY 1 HAVING count(*) = 1) p ON p.k = lower(concat(source, '/', d.doc_id + 1)) LEFT JOIN (SELECT cast(doc_id AS varchar) AS k, max(doc_id) AS n FROM documents GROUP BY 1 HAVING count(*) = 1) t ON t.k = cast(d.doc_id + 1 AS varchar)")
def link_resolution(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.col("doc_id").cast("string").alias("title"))
    return G.resolve_links(_links(spark, sf_dir), known).select("note_id", "target", F.coalesce("target_note_id", F.lit(-1)).alias("target_note_id"))


@query("SELECT doc_id AS note_id, concat(source, '/', doc_id + 1) AS target, 7::bigint AS line, 'next' AS alias FROM documents")
def link_dedup(spark, sf_dir):
    """Each link is given twice, the second time without an alias."""
    found = _links(spark, sf_dir)
    twice = found.unionByName(found.withColumn("place", F.col("place") + 1).withColumn("alias", F.lit(None).cast("string")))
    return G.dedup_links(twice).select("note_id", "target", "line", "alias")


@query("WITH g AS (SELECT source, doc_id, concat(source, '/', doc_id, '.md') AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT source AS item_id, count(*) AS paths, count_if(doc_id % 13 <> 0)::bigint AS bound, count_if(doc_id % 13 = 0)::bigint AS missing FROM g GROUP BY source")
def gold_binding(spark, sf_dir):
    """Gold items by source, their paths bound to note ids; every thirteenth note is unknown."""
    from marginalia.sources.evaluation import bind_gold

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    gold = good.select(F.col("source").alias("item_id"), "path")
    index = docs.where("doc_id % 13 <> 0").select("path", F.col("doc_id").alias("note_id"))
    return bind_gold(gold, index).groupBy("item_id").agg(F.count(F.lit(1)).alias("paths"), F.count("note_id").alias("bound"), F.count_if(F.col("note_id").isNull()).alias("missing"))


@query("SELECT doc_id, cast(CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id END AS bigint) AS note_id FROM documents")
def path_resolution(spark, sf_dir):
    """Paths with backslashes and blanks find their notes; every fourth note is unknown."""
    from marginalia.sources.evaluation import bind_gold

    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    asked = docs.select(F.col("doc_id").alias("item_id"), F.concat(F.lit(" "), F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    return bind_gold(asked, docs.where("doc_id % 4 <> 0").select("path", F.col("doc_id").alias("note_id"))).select(F.col("item_id").alias("doc_id"), F.coalesce("note_id", F.lit(-1)).alias("note_id"))


@query("WITH o AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 3 <> 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return G.upsert(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1").withColumn("n_chars", F.col("n_chars") + 1), ["doc_id"])


@query("SELECT source, lang, CASE WHEN lang IN ('en', 'fr') THEN 'old' ELSE 'new' END AS state, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') OR doc_id % 2 = 0 GROUP BY ALL HAVING count(*) > 0")
def replace_generation(spark, sf_dir):
    """Documents of the other languages are replaced, by language, by their even ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    new = d.where("lang NOT IN ('en', 'fr') AND doc_id % 2 = 0").withColumn("state", F.lit("new"))
    return G.replace_generation(d.withColumn("state", F.lit("old")), new, ["lang"]).groupBy("source", "lang", "state").agg(F.count(F.lit(1)).alias("n"))


def _run(spark, sf_dir):
    new, old = _snapshots(spark, sf_dir)
    failed = F.col("parse_status") == "failed"
    found = new.withColumns({"error_type": F.when(failed, "ValueError"), "error_message": F.when(failed, F.concat(F.lit("cannot parse "), F.col("relative_path")))})
    number = F.regexp_extract("relative_path", r"/(\d+)\.md$", 1).cast("long")
    stored = old.withColumns({"note_id": number, "source_directory": F.split_part("relative_path", F.lit("/"), F.lit(1)), "title": number.cast("string"), "parse_status": F.when(F.col("last_status") == "failed", "failed").otherwise("parsed")})
    links = found.select("relative_path", F.concat("source_directory", F.lit("/"), (number + 2).cast("string")).alias("target"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("line"), F.lit(0).alias("place"))
    return G.run(found, stored, links, 7, "all")


_AFTER = _SNAP + """, after AS (SELECT coalesce(inc.relative_path, prev.relative_path) AS relative_path, CASE WHEN decision IN ('new', 'changed') OR prev.relative_path IS NULL THEN inc.content_hash ELSE prev.content_hash END AS content_hash, CASE WHEN decision IN ('new', 'changed') THEN 'parsed' WHEN prev.relative_path IS NULL THEN 'failed' WHEN prev.last_status = 'failed' THEN 'failed' ELSE 'parsed' END AS parse_status,
 CASE WHEN decision IN ('new', 'changed') OR prev.relative_path IS NULL THEN 'p1' ELSE prev.parser_version END AS parser_version, prev.relative_path IS NOT NULL AS had_id FROM dec JOIN inc USING (relative_path) FULL JOIN prev USING (relative_path))"""


@query(f"WITH {_AFTER} SELECT relative_path, content_hash, parse_status, parser_version, CASE WHEN had_id THEN regexp_extract(relative_path, '/([0-9]+)\\.md$', 1)::bigint ELSE -1 END AS old_id FROM after")
def ingest_run_notes(spark, sf_dir):
    """The notes after a whole run; ids of notes that are new are hashes, shown as -1."""
    known = F.regexp_extract("relative_path", r"/(\d+)\.md$", 1).cast("long")
    return _run(spark, sf_dir)["notes"].select("relative_path", "content_hash", "parse_status", "parser_version", F.when(F.col("note_id") == known, known).otherwise(F.lit(-1)).alias("old_id"))


@query(f"WITH {_SNAP} SELECT relative_path, decision AS status, reason, coalesce(CASE WHEN decision = 'failed' THEN concat('ValueError: cannot parse ', relative_path) END, 'none') AS error, 7::bigint AS run_id FROM dec UNION ALL SELECT relative_path, 'stale', 'not_discovered', 'none', 7 FROM stale")
def ingest_run_states(spark, sf_dir):
    error = F.coalesce(F.concat("error_type", F.lit(": "), "error_message"), F.lit("none"))
    return _run(spark, sf_dir)["states"].select("relative_path", "status", "reason", error.alias("error"), "run_id")


@query(f"WITH {_AFTER}, l AS (SELECT inc.relative_path, regexp_extract(inc.relative_path, '/([0-9]+)\\.md$', 1)::bigint AS n, source FROM inc JOIN dec USING (relative_path) WHERE decision <> 'failed') SELECT l.relative_path, concat(l.source, '/', n + 2) AS target, (SELECT count(*) FROM after a WHERE a.relative_path = concat(l.source, '/', n + 2, '.md') OR regexp_extract(a.relative_path, '/([0-9]+)\\.md$', 1) = cast(n + 2 AS varchar)) = 1 AS resolved FROM l")
def ingest_run_links(spark, sf_dir):
    """Every parsed note links to the note two further on."""
    made = _run(spark, sf_dir)
    return made["links"].join(made["notes"].select("note_id", "relative_path"), "note_id").select("relative_path", "target", F.col("target_note_id").isNotNull().alias("resolved"))


@query(f"WITH {_COUNTERS} SELECT 7::bigint AS run_id, 'all' AS corpus_scope, total, \"new\", changed, unchanged, failed, stale, round((\"new\" + changed + unchanged) / total, 6) AS success_rate, \"new\" + changed + unchanged AS succeeded, unchanged AS skipped, CASE WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM c")
def ingest_run(spark, sf_dir):
    return _run(spark, sf_dir)["run"]


@query(f"WITH {_COUNTERS} SELECT 7::bigint AS run_id, 'all' AS corpus_scope, total, \"new\", changed, unchanged, failed, stale, round((\"new\" + changed + unchanged) / total, 6) AS success_rate, \"new\" + changed + unchanged AS succeeded, unchanged AS skipped, CASE WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM c")
def ingest_run_observed(spark, sf_dir):
    """The row of ``ingest_run`` from counters of the write of its states."""
    from marginalia.sources.storage import new_folder

    return G.store_states(_run(spark, sf_dir)["states"], new_folder(spark, "states"), 7, "all")
