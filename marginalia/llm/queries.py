"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, exact_dedup, html_text, language_id, lexical_search, license_scan, mixing, near_dedup, sharding, spelling, token_store, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.annotate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.annotate(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.annotate(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.annotate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.annotate(_table(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.annotate(_table(spark, sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), 10)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), least_length=6, least=5, ratio=5, noise=199)


def _rules_for_sql() -> str:
    """The rules with regular expressions made here, as VALUES of (kind, rule, action, regex)."""
    rows = []
    for kind, rule, action in url_filter.DEFAULT:
        if kind == "host":
            regex = r"^([^/]*\.)?" + re.escape(rule)
        else:
            inner = "".join({"*": r"[\s\S]*", "^": r"([^0-9a-z_.%\-]|$)"}.get(c, re.escape(c)) for c in rule.strip("|").lower())
            front = r"^[a-z][0-9a-z+.\-]*://([^/?#]*\.)?" if rule.startswith("||") else "^" if rule.startswith("|") else ""
            regex = front + inner + ("$" if rule.endswith("|") else "")
        rows.append("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (kind, rule, action, regex)) + ")")
    return "(VALUES " + ",\n".join(rows) + ") v(kind, rule, action, regex)"


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_store, op3_decontaminate, op4_exact_dedup, op5_license_scan, op6_language_id, op7_toxicity, op8_mixing, op9_sharding, op10_html_text, op11_url_filter, op12_lexical_search, op13_spelling)}

SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY length(t) DESC, doc_id) AS place, count(*) OVER (PARTITION BY body) AS group_size FROM d),
k AS (SELECT body, doc_id AS keep_id FROM g WHERE place = 1)
SELECT g.doc_id, k.keep_id, g.group_size, g.doc_id = k.keep_id AS kept, sha256(g.body) AS text_sha256 FROM g JOIN k USING (body)
""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, md5('mix' || cast(doc_id AS varchar)) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS weight, 2.0::double * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM w),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS used,
 sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::double AS open, (SELECT sum(source_size) FROM s)::double * 1.5 AS total FROM o),
l AS (SELECT *, (total - used) / open AS level FROM c),
m AS (SELECT coalesce((SELECT level FROM l WHERE most > level * weight ORDER BY place LIMIT 1), 'infinity'::double) AS level),
t AS (SELECT source, source_size, least(m.level * weight, most) AS target FROM w, m),
b AS (SELECT d.*, t.source_size, t.target, floor(t.target)::bigint AS budget,
 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint AS taken FROM e
""",
    "op9_sharding": r"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::bigint AS n_bytes, ('0x' || substr(md5(cast(doc_id AS varchar)), 1, 10))::bigint AS hash FROM documents),
a AS (SELECT doc_id, n_bytes, unnest(range(0, 41)) AS depth, hash FROM d),
p AS (SELECT doc_id, n_bytes, depth, hash >> (40 - depth)::int AS prefix FROM a),
b AS (SELECT depth, prefix, sum(n_bytes)::bigint AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL HAVING sum(n_bytes) <= 1048576 OR count(*) = 1),
f AS (SELECT p.doc_id, p.n_bytes, p.prefix, p.depth, b.shard_bytes, b.shard_docs, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS place FROM p JOIN b USING (depth, prefix))
SELECT doc_id, n_bytes, concat(depth, '-', prefix) AS shard, depth::int AS depth, shard_bytes, shard_docs FROM f WHERE place = 1
""",
    "op11_url_filter": r"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY kind = 'host', kind <> 'host' AND action = 'allow', length(rule), rule) AS rank FROM """
    + _rules_for_sql()
    + r"""),
p AS (SELECT row_number() OVER () AS place, page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
 translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT place, kind, max_by(rule, rank) AS rule, max_by(action, rank) AS action FROM p, r WHERE CASE kind WHEN 'host' THEN regexp_matches(host || path, regex) ELSE regexp_matches(low, regex) END GROUP BY ALL)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.action, m.action, 'allow') AS verdict, m.rule AS pattern
FROM p LEFT JOIN f h ON h.place = p.place AND h.kind = 'host' LEFT JOIN f m ON m.place = p.place AND m.kind = 'pattern'
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT place, doc_id, len(ts)::bigint AS n, unnest(ts) AS term FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::bigint AS docs, sum(len(ts))::bigint AS terms FROM d WHERE len(ts) > 0),
f AS (SELECT place, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::bigint AS tf FROM t GROUP BY place, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM f, s GROUP BY term, docs),
q AS (SELECT place, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS place, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)),
a AS (SELECT place, any_value(item_id) AS item_id, term, count(*)::bigint AS r FROM q GROUP BY place, term),
c AS (SELECT a.place, any_value(a.item_id) AS item_id, f.doc_id, f.place AS doc, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::bigint AS score FROM a JOIN w USING (term) JOIN f USING (term), s GROUP BY a.place, f.place, f.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM o WHERE rank <= 10
""",
}
