"""Text functions and corpus statistics over the documents."""

from pyspark.sql import functions as F

from marginalia.functions import identity as I, text as T
from marginalia.operators import statistics as S
from marginalia.plans.registry import query, table

_WORDS = r"list_filter(regexp_extract_all({t}, 'https?://\S+|[\p{{L}}\p{{N}}]+(?:[-_][\p{{L}}\p{{N}}]+)*'), lambda w: NOT regexp_matches(w, '^https?://|_|[\p{{Nd}}²³¹⁰-⁹₀-₉]'))"
_PLAIN = r"regexp_replace(text, '(!?)(\[\[|\]\]|`{1,3}|\*\*|__|[*_#])', '', 'g')"
_LANGUAGE = r"CASE WHEN NOT regexp_matches({w}, '\p{{L}}') THEN 'unknown' WHEN regexp_matches(lower({w}), '[а-я]') AND regexp_matches(lower({w}), '[a-z]') THEN 'mixed_or_other' WHEN regexp_matches(lower({w}), '[а-я]') THEN 'russian' WHEN regexp_matches(lower({w}), '[a-z]') THEN 'english' ELSE 'mixed_or_other' END"
_COUNTS = ", ".join(f"len(list_filter(words, lambda w: {_LANGUAGE.format(w='w')} = '{k}'))::bigint AS {k}_word_count" for k in T.LANGUAGES)
STATS = f"""p AS (SELECT doc_id, source, text, {_PLAIN} AS plain FROM documents), w AS (SELECT *, {_WORDS.format(t='plain')} AS words FROM p),
stats AS (SELECT doc_id, source, octet_length(encode(text))::bigint AS file_size_bytes, length(text)::bigint AS character_count, len(words)::bigint AS word_count, {_COUNTS}, sha256(text) AS content_hash,
CASE WHEN trim(text) = '' THEN 'empty_document' WHEN trim(plain) = '' THEN 'no_text_after_structure' END AS anomaly FROM w)"""


def stats_sql(column: str) -> str:
    names = {"min": f"min({column})", "max": f"max({column})", "mean": f"avg({column})", "median": f"quantile_cont({column}, 0.5)", "std": f"coalesce(stddev_samp({column}), 0)", "p25": f"quantile_cont({column}, 0.25)", "p75": f"quantile_cont({column}, 0.75)", "p90": f"quantile_cont({column}, 0.9)", "p95": f"quantile_cont({column}, 0.95)"}
    return f"count({column}) AS count, " + ", ".join(f"round(({v})::double, 6) AS {k}" for k, v in names.items())


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"WITH {STATS} SELECT * FROM stats")
def doc_stats(spark, sf_dir):
    return S.documents(_docs(spark, sf_dir))


@query(f"WITH {STATS} SELECT 'bytes' AS metric, {stats_sql('file_size_bytes')} FROM stats UNION ALL SELECT 'words', {stats_sql('word_count')} FROM stats")
def size_distribution(spark, sf_dir):
    rows = S.documents(_docs(spark, sf_dir)).select(F.explode(F.array(F.struct(F.lit("bytes").alias("metric"), F.col("file_size_bytes").alias("v")), F.struct(F.lit("words").alias("metric"), F.col("word_count").alias("v")))).alias("x"))
    return rows.groupBy("x.metric").agg(*S.distribution(F.col("x.v")))


@query(f"WITH {STATS} SELECT source, count(*) AS documents, round(median(file_size_bytes)::double, 6) AS median_bytes, round(quantile_cont(file_size_bytes, 0.95)::double, 6) AS p95_bytes, round(median(word_count)::double, 6) AS median_words, round(quantile_cont(word_count, 0.95)::double, 6) AS p95_words FROM stats GROUP BY source")
def directory_stats(spark, sf_dir):
    r6 = lambda c, q: F.round(F.percentile(c, q), 6)
    return S.documents(_docs(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), r6("file_size_bytes", 0.5).alias("median_bytes"), r6("file_size_bytes", 0.95).alias("p95_bytes"), r6("word_count", 0.5).alias("median_words"), r6("word_count", 0.95).alias("p95_words"))


@query(f"WITH {STATS} SELECT content_hash, count(*) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM stats GROUP BY content_hash HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return S.duplicate_groups(S.documents(_docs(spark, sf_dir)))


@query("WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents) SELECT content_hash, count(*) OVER (PARTITION BY content_hash) AS documents, doc_id FROM h QUALIFY documents > 1")
def duplicate_members(spark, sf_dir):
    return S.duplicate_members(S.documents(_docs(spark, sf_dir)))


@query(f"WITH {STATS} SELECT coalesce(anomaly, 'none') AS anomaly, count(*) AS documents, round(count(*) / sum(count(*)) OVER (), 6)::double AS share FROM stats GROUP BY 1")
def anomalies(spark, sf_dir):
    rows = S.documents(_docs(spark, sf_dir)).groupBy(F.coalesce("anomaly", F.lit("none")).alias("anomaly")).agg(F.count(F.lit(1)).alias("documents"))
    total = rows.agg(F.sum("documents").alias("total"))
    return rows.crossJoin(total).select("anomaly", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))


@query(f"""WITH {STATS}, g AS (SELECT content_hash, count(*) AS n FROM stats GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS total_documents, sum(file_size_bytes)::bigint AS total_bytes, sum(word_count)::bigint AS total_words, round(avg(file_size_bytes), 6) AS mean_bytes, round(median(file_size_bytes)::double, 6) AS median_bytes,
round(avg((anomaly IS NOT NULL)::int), 6) AS anomaly_rate, (SELECT count(*) FROM g) AS duplicate_groups, (SELECT coalesce(sum(n), 0)::bigint FROM g) AS duplicate_documents FROM stats""")
def inventory_summary(spark, sf_dir):
    return S.summary(S.documents(_docs(spark, sf_dir)))


@query(f"WITH w AS (SELECT unnest({_WORDS.format(t='text')}) AS word FROM documents) SELECT {_LANGUAGE.format(w='word')} AS language, count(*) AS words, count(DISTINCT word) AS different FROM w GROUP BY 1")
def language_mix(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.explode_outer(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("word"))
    words = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(~F.col("word").rlike(T.TECHNICAL))  # rules are tried once a different word
    return words.groupBy(T.language(F.col("word")).alias("language")).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("different"))


@query(f"WITH {STATS} SELECT source, round(CASE WHEN sum(word_count) = 0 THEN 0 ELSE sum(english_word_count) / sum(word_count) END, 6)::double AS english_share, round(CASE WHEN sum(english_word_count) = 0 THEN NULL ELSE sum(russian_word_count) / sum(english_word_count) END, 6)::double AS russian_to_english FROM stats GROUP BY source")
def language_ratio(spark, sf_dir):
    g = S.documents(_docs(spark, sf_dir)).groupBy("source").agg(F.sum("word_count").alias("n"), F.sum("english_word_count").alias("en"), F.sum("russian_word_count").alias("ru"))
    return g.select("source", F.round(T.safe_ratio(F.col("en"), F.col("n")), 6).alias("english_share"), F.round(T.safe_ratio(F.col("ru"), F.col("en"), None), 6).alias("russian_to_english"))


@query(r"SELECT doc_id, ceil(length(regexp_replace(text, '^\s+|\s+$', '', 'g')) / 4)::bigint AS estimated_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint AS chunk_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.estimated_tokens(F.col("text")).alias("estimated_tokens"), T.chunk_token_count(F.col("text")).alias("chunk_tokens"))


@query(rf"SELECT doc_id, len({_WORDS.format(t='text')})::bigint AS natural_words, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::bigint AS chunk_words FROM documents")
def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.natural_word_count(F.col("text")).alias("natural_words"), T.chunk_word_count(F.col("text")).alias("chunk_words"))


@query(f"SELECT doc_id, sha256({_PLAIN}) AS plain_hash, length({_PLAIN})::bigint AS plain_chars FROM documents")
def analysis_text(spark, sf_dir):
    plain = T.analysis_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(plain, 256).alias("plain_hash"), F.length(plain).cast("long").alias("plain_chars"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


_KEY = "sha256(concat(source, '/', doc_id, '.md', chr(0), sha256(text), chr(0), 'v1', chr(0), '0'))"


@query(f"SELECT doc_id, {_KEY} AS point_key FROM documents")
def point_key(spark, sf_dir):
    path = I.note_path(F.col("source"), F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", I.point_key(path, T.content_hash(F.col("text")), F.lit("v1"), F.lit(0)).alias("point_key"))


@query(f"""WITH d AS (SELECT doc_id, sha1(unhex('{I.URL_NAMESPACE}') || encode(concat(source, '/', doc_id))) AS h FROM documents)
SELECT doc_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END, h[18:20], '-', h[21:32]) AS point_id FROM d""")
def point_uuid(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", I.uuid5(F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("SELECT source, lang, count(*) AS documents, concat(lower(source), '__', lower(lang), '__v1-0__md') AS collection FROM documents GROUP BY ALL")
def collection_name(spark, sf_dir):
    rows = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"))
    return rows.withColumn("collection", I.collection_name(F.col("source"), F.col("lang"), F.lit(" v1.0 "), F.lit("md")))


@query("SELECT DISTINCT concat_ws('|', source, lang, 'v1') AS fingerprint FROM documents")
def cache_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select(I.cache_fingerprint(F.col("source"), F.col("lang"), F.lit("v1")).alias("fingerprint")).distinct()


@query(r"SELECT doc_id, concat(source, '/', doc_id, '.md') AS path, cast(doc_id AS varchar) AS title, lower(concat(source, '/', doc_id)) AS path_key, concat(source, '/', doc_id) AS base FROM documents")
def note_names(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", I.note_path(F.col("source"), F.col("doc_id")).alias("path"))
    return rows.select("doc_id", "path", I.note_title(F.col("path")).alias("title"), I.path_key(F.col("path")).alias("path_key"), I.link_base(F.concat(F.lit("./"), F.col("path"), F.lit("#part"))).alias("base"))
