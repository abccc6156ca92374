"""Chunking and run summaries. Events stand for logged requests, lines of the documents for chunks."""

from pyspark.sql import functions as F

from marginalia.operators import chunking as C, experiments as E
from marginalia.plans.markdown import _LINES, _SECTIONS
from marginalia.plans.registry import notes, query, table


@query()
def chunk_recursive(spark, sf_dir):
    """Rows only: the splitter is tested against its rules."""
    rows = C.chunks(notes(spark, sf_dir).select("note_id", "note"), C.Policy(128, 16))
    return rows.select("note_id", "chunk_index", "section_no", "section_level", "start_offset", "end_offset", "word_count", "token_count", F.sha2("text", 256).alias("text_hash"))


_CUT = _LINES.replace("WITH ", "WITH RECURSIVE ", 1) + r""", n AS (SELECT *, count(level) OVER (PARTITION BY note_id ORDER BY line) AS section_no, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint AS tokens FROM lines),
p AS (SELECT *, row_number() OVER (PARTITION BY note_id, section_no ORDER BY line) AS i FROM n),
g(note_id, section_no, i, line, chunk, used) AS (SELECT note_id, section_no, i, line, 0::bigint, tokens FROM p WHERE i = 1
 UNION ALL SELECT p.note_id, p.section_no, p.i, p.line, CASE WHEN g.used + p.tokens > 40 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.used + p.tokens > 40 THEN p.tokens ELSE g.used + p.tokens END FROM g JOIN p ON p.note_id = g.note_id AND p.section_no = g.section_no AND p.i = g.i + 1),
c AS (SELECT p.note_id, p.section_no, chunk, min(p.start) AS begin, string_agg(p.text, chr(10) ORDER BY p.line) AS raw, string_agg(CASE WHEN level IS NULL THEN p.text END, chr(10) ORDER BY p.line) AS own FROM g JOIN p USING (note_id, section_no, i) GROUP BY ALL),
h AS (SELECT note_id, section_no, max(level) AS level, max(title) AS title FROM n GROUP BY ALL),
d AS (SELECT c.*, trim(concat(repeat('#', level::int), ' ', title)) AS heading, level, regexp_replace(raw, '^\s+', '') AS front, regexp_replace(coalesce(own, ''), '^\s+|\s+$', '', 'g') AS inner_text FROM c JOIN h USING (note_id, section_no) WHERE regexp_matches(raw, '\S')),
e AS (SELECT *, begin + length(raw) - length(front) AS start_offset, begin + length(raw) - length(front) + length(regexp_replace(front, '\s+$', '')) AS end_offset, CASE WHEN level IS NULL THEN inner_text WHEN inner_text = '' THEN heading ELSE concat(heading, chr(10), chr(10), inner_text) END AS text FROM d)"""


@query(_CUT + r""" SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY section_no, chunk) - 1 AS chunk_index, section_no, start_offset::bigint AS start_offset, end_offset::bigint AS end_offset, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint AS token_count, sha256(text) AS text_hash FROM e""")
def chunk_lines(spark, sf_dir):
    """Sections split at line breaks into chunks of at most 40 tokens where lines allow it."""
    rows = C.chunks(notes(spark, sf_dir).select("note_id", "note"), C.Policy(40, 0, ("\n",), False, False, False))
    return rows.select("note_id", "chunk_index", "section_no", "start_offset", "end_offset", "token_count", F.sha2("text", 256).alias("text_hash"))


@query("SELECT 0::bigint AS invalid")
def chunk_validity(spark, sf_dir):
    return C.invalid(C.chunks(notes(spark, sf_dir).select("note_id", "note"), C.Policy(256, 32))).agg(F.count(F.lit(1)).alias("invalid"))


_CH = r"""l AS (SELECT doc_id, lang, length(text) AS source_length, unnest(string_split(text, chr(10))) AS text FROM documents), c AS (SELECT lang, source_length, text, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint AS token_count, length(text) AS end_offset FROM l WHERE trim(text) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY token_count) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM c)"""


def _line_chunks(spark, sf_dir):
    from marginalia.functions.text import chunk_token_count

    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("source_length"), F.explode(F.split("text", "\n", -1)).alias("text")).where(F.trim("text") != "")
    return rows.select("lang", "source_length", "text", chunk_token_count(F.col("text")).alias("token_count"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"))


@query(f"""WITH {_CH} SELECT lang, count(*) AS chunks_total, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN token_count END) AS median_token_length, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN token_count END) AS p95_token_length, round(avg(token_count), 6) AS mean_token_length,
 round(avg((token_count < 16)::int), 6) AS short_rate, (count(*) - count(DISTINCT text))::bigint AS duplicate_hash_count, sum(octet_length(encode(text)))::bigint AS storage_bytes, count_if(end_offset > source_length)::bigint AS boundary_violation_count FROM o GROUP BY lang""")
def chunk_metrics(spark, sf_dir):
    return C.metrics(_line_chunks(spark, sf_dir), 64, "lang")


@query(f"WITH {_CH}, p AS (SELECT unnest([64, 256, 512])::bigint AS chunk_size) SELECT concat('size-', chunk_size) AS policy, count(*) AS sections, count_if(token_count > chunk_size)::bigint AS oversized FROM c, p GROUP BY 1")
def policy_matrix(spark, sf_dir):
    policies = spark.createDataFrame([(f"size-{n}", n) for n in (64, 256, 512)], "policy string, chunk_size long")
    return C.oversized(_line_chunks(spark, sf_dir), policies)


_EV = "e AS (SELECT *, event_id % 2 = 0 AS canonical, event_id % 3 = 0 AS hit, event_id % 500 AS tokens, value AS latency_ms FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("latency_ms", F.col("value")).withColumn("tokens", F.col("event_id") % 500)


@query(f"""WITH {_EV} SELECT count(DISTINCT user_id) AS group_count, count_if(canonical)::bigint AS canonical_count, count_if(NOT canonical)::bigint AS paraphrase_count, count_if(NOT canonical AND hit)::bigint AS paraphrase_hits, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms,
 round(quantile_cont(CASE WHEN canonical THEN latency_ms END, 0.5), 6) AS canonical_latency_p50_ms, sum(CASE WHEN canonical THEN tokens ELSE 0 END)::bigint AS pass1_tokens, sum(CASE WHEN NOT canonical THEN tokens ELSE 0 END)::bigint AS pass2_tokens, round(avg(CASE WHEN NOT canonical AND hit THEN latency_ms END), 6) AS hit_avg_latency_ms, round(avg(CASE WHEN NOT canonical AND NOT hit THEN latency_ms END), 6) AS miss_avg_latency_ms,
 round(count_if(NOT canonical AND hit) / count_if(NOT canonical), 6) AS hit_rate, greatest(sum(CASE WHEN canonical THEN tokens ELSE 0 END) - sum(CASE WHEN NOT canonical THEN tokens ELSE 0 END), 0)::bigint AS tokens_saved FROM e""")
def cache_summary(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("group_id"), F.when(F.col("event_id") % 2 == 0, "canonical").otherwise("paraphrase").alias("pass"), (F.col("event_id") % 3 == 0).alias("hit"), "latency_ms", F.col("tokens").alias("prompt_tokens"), F.lit(None).cast("long").alias("generated_tokens"))
    return E.cache_summary(rows)


@query("""WITH e AS (SELECT [800, 1200, 1800][(event_id % 3 + 1)::int]::bigint AS budget, event_id % 10 = 0 AS skipped, event_id % 7 = 0 AS refused, event_id % 900 AS pt, value AS lat, event_id % 5 AS packed, (event_id % 100) / 100.0 AS ndcg FROM events)
SELECT budget, count(*) AS question_count, count_if(NOT skipped AND NOT refused)::bigint AS scored_count, count_if(skipped)::bigint AS skipped_count, count_if(NOT skipped AND refused)::bigint AS refused_count, round(avg(CASE WHEN NOT skipped THEN pt END), 6) AS mean_prompt_tokens, round(quantile_cont(CASE WHEN NOT skipped THEN pt END, 0.5)::double, 6) AS median_prompt_tokens,
 round(quantile_cont(CASE WHEN NOT skipped THEN pt END, 0.95)::double, 6) AS p95_prompt_tokens, round(avg(CASE WHEN NOT skipped THEN lat END), 6) AS mean_latency_ms, round(quantile_cont(CASE WHEN NOT skipped THEN lat END, 0.5), 6) AS p50_latency_ms, round(quantile_cont(CASE WHEN NOT skipped THEN lat END, 0.95), 6) AS p95_latency_ms, round(avg(CASE WHEN NOT skipped THEN packed END), 6) AS mean_packed_chunks,
 round(avg(CASE WHEN NOT skipped AND NOT refused THEN ndcg END), 6)::double AS mean_ndcg, round(count_if(NOT skipped AND refused) / count(*), 6) AS refusal_rate FROM e GROUP BY budget""")
def budget_summary(spark, sf_dir):
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.get(F.array(*[F.lit(b).cast("long") for b in (800, 1200, 1800)]), (i % 3).cast("int")).alias("budget"), (i % 10 == 0).alias("skipped"), (i % 7 == 0).alias("refused"), (i % 900).alias("prompt_tokens"), "latency_ms", (i % 5).alias("packed_chunks"), ((i % 100) / 100).alias("ndcg"))
    return E.budget_summary(rows)


@query("""WITH e AS (SELECT *, event_id % 10 = 0 AS skipped FROM events) SELECT count(*) AS question_count, count_if(NOT skipped)::bigint AS scored_count, count_if(skipped)::bigint AS skipped_count, count_if(event_id % 7 = 0)::bigint AS refused_count, round(avg(CASE WHEN NOT skipped THEN (event_id % 11) / 10.0 END), 6)::double AS faithfulness,
 round(avg(CASE WHEN NOT skipped THEN (event_id % 13) / 12.0 END), 6)::double AS answer_relevancy, round(avg(CASE WHEN NOT skipped THEN (event_id % 17) / 16.0 END), 6)::double AS context_precision, round(avg(CASE WHEN NOT skipped THEN (event_id % 19) / 18.0 END), 6)::double AS context_recall, round(avg(CASE WHEN NOT skipped THEN value END), 6) AS mean_latency_ms,
 sum(event_id % 500)::bigint AS total_prompt_tokens, round(avg(event_id % 500), 6) AS mean_prompt_tokens, round(median(event_id % 500)::double, 6) AS median_prompt_tokens, sum(event_id % 90)::bigint AS total_generated_tokens, round(avg(event_id % 90), 6) AS mean_generated_tokens, round(median(event_id % 90)::double, 6) AS median_generated_tokens, count(DISTINCT user_id) AS notes_processed FROM e""")
def generation_summary(spark, sf_dir):
    i = F.col("event_id")
    rows = _events(spark, sf_dir).select((i % 10 == 0).alias("skipped"), (i % 7 == 0).alias("refused"), ((i % 11) / 10).alias("faithfulness"), ((i % 13) / 12).alias("answer_relevancy"), ((i % 17) / 16).alias("context_precision"), ((i % 19) / 18).alias("context_recall"), "latency_ms", (i % 500).alias("prompt_tokens"), (i % 90).alias("generated_tokens"), F.array(F.col("user_id").cast("string")).alias("note_paths"))
    return E.generation_summary(rows)


@query("SELECT event_type, count(*) AS requests, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return E.latency_percentiles(_events(spark, sf_dir), "event_type")


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def skip_reasons(spark, sf_dir):
    return E.skip_reasons(_events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("reason")))


@query("SELECT event_type, count(*) AS n, round(stddev_pop(value), 6) AS spread FROM events GROUP BY event_type")
def score_spread(spark, sf_dir):
    return E.score_spread(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_id, (event_id % 700)::bigint AS est_tokens, (event_id % 9)::bigint AS packed FROM events")
def gate_traces(spark, sf_dir):
    from marginalia.functions.policies import gate_packed, gate_tokens

    i = F.col("event_id")
    trace = F.concat(F.lit("gate: packed="), (i % 9).cast("string"), F.lit(" budget=1200 est_tokens="), (i % 700).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", gate_tokens(trace).alias("est_tokens"), gate_packed(trace).alias("packed"))


_WHOLE = _SECTIONS + r""", t AS (SELECT note_id, section_no, min(start) AS start, string_agg(text, chr(10) ORDER BY line) AS source FROM n GROUP BY note_id, section_no),
c AS (SELECT s.note_id, s.section_no, s.level, t.start + length(t.source) - length(regexp_replace(t.source, '^\s+', '')) AS start_offset, t.start + length(regexp_replace(t.source, '\s+$', '')) AS end_offset,
 concat_ws(chr(10) || chr(10), CASE WHEN s.level IS NOT NULL THEN trim(concat(repeat('#', s.level), ' ', s.title)) END, CASE WHEN body <> '' THEN body END) AS text FROM s JOIN t USING (note_id, section_no))"""


@query(_WHOLE + r" SELECT note_id, row_number() OVER (PARTITION BY note_id ORDER BY section_no) - 1 AS chunk_index, section_no, start_offset::bigint AS start_offset, end_offset::bigint AS end_offset, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint AS token_count, sha256(text) AS text_hash FROM c WHERE text <> ''")
def chunk_sections(spark, sf_dir):
    """A policy of very large chunks: each section is one, with its place in the note."""
    rows = C.chunks(notes(spark, sf_dir).select("note_id", "note"), C.Policy(1 << 30, 0))
    return rows.select("note_id", "chunk_index", "section_no", "start_offset", "end_offset", "token_count", F.sha2("text", 256).alias("text_hash"))


@query(_WHOLE + r""", k AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::bigint AS token_count FROM c WHERE text <> ''), z AS (SELECT *, row_number() OVER (ORDER BY token_count) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT 'whole' AS policy, count(*) AS chunks_total, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN token_count END) AS median_token_length, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN token_count END) AS p95_token_length, round(avg(token_count), 6) AS mean_token_length, 268435456::bigint AS short_threshold, 1.0::double AS short_rate,
 (count(*) - count(DISTINCT text))::bigint AS duplicate_hash_count, sum(octet_length(encode(text)))::bigint AS storage_bytes, 0::bigint AS boundary_violation_count, 0::bigint AS oversized_sections_total, 0::bigint AS overlap_enabled, 1.0::double AS metadata_completeness FROM z""")
def chunk_experiment(spark, sf_dir):
    """The corpus chunked under a policy, with its metrics; the policy of whole sections is the one that SQL can follow."""
    rows = C.experiment(notes(spark, sf_dir).select("note_id", "note"), {"whole": C.Policy(1 << 30, 0)})
    return rows.select("policy", *[F.col(c) for c in rows.columns if c != "policy"])


@query()
def chunk_policies(spark, sf_dir):
    """Three policies that split sections; their rules are tested on the chunks."""
    return C.experiment(notes(spark, sf_dir).select("note_id", "note"), {f"size-{n}": C.Policy(n, n // 8) for n in (64, 256, 512)})


def _stored(spark, sf_dir):
    """Lines of documents stand for stored chunks of two versions, by the document's parity."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("chunking_version"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    return rows.where(F.trim("text") != "")


_STORED = "c AS (SELECT doc_id AS note_id, concat('v', doc_id % 2) AS chunking_version, unnest(range(0, len(string_split(text, chr(10))))) AS chunk_index, unnest(string_split(text, chr(10))) AS text FROM documents), k AS (SELECT * FROM c WHERE trim(text) <> '')"


@query(f"WITH {_STORED} SELECT count(*) AS chunks FROM k WHERE chunking_version = 'v1'")
def chunk_count(spark, sf_dir):
    return C.count_by_version(_stored(spark, sf_dir), "v1")


@query(f"WITH {_STORED} SELECT note_id, chunk_index, text FROM k WHERE chunking_version = 'v1' AND note_id IN (1, 3, 5, 8)")
def chunk_generation(spark, sf_dir):
    return C.generation(_stored(spark, sf_dir), "v1", 1, 3, 5, 8).select("note_id", "chunk_index", "text")


@query(f"WITH {_STORED} SELECT chunking_version, count(DISTINCT note_id) AS notes, count(*) AS chunks FROM k WHERE NOT (note_id % 3 = 0 AND chunking_version = 'v1') GROUP BY 1")
def chunk_delete(spark, sf_dir):
    """Generations of every third note in one version are deleted."""
    gone = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("note_id"), F.lit("v1").alias("chunking_version"))
    return C.delete_generations(_stored(spark, sf_dir), gone).groupBy("chunking_version").agg(F.count_distinct("note_id").alias("notes"), F.count(F.lit(1)).alias("chunks"))


@query("""SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'note_id' WHEN 1 THEN 'chunk_index' WHEN 2 THEN 'text,word_count,token_count' WHEN 3 THEN 'offsets' WHEN 4 THEN 'word_count' WHEN 5 THEN 'token_count' WHEN 6 THEN 'parser_version' WHEN 7 THEN 'source_content_hash' WHEN 8 THEN 'chunking_version' WHEN 9 THEN 'offsets,chunking_version' END AS broken
FROM documents WHERE doc_id % 11 < 10 AND trim(text) <> '' AND len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) > 0""")
def chunk_rules(spark, sf_dir):
    """Documents as chunks, each but every eleventh with a fault of its own."""
    from marginalia.functions import text as T

    d = table(spark, sf_dir, "documents").where(F.trim("text") != "").where(F.regexp_count("text", F.lit(T.CHUNK_WORD)) > 0)
    m = F.col("doc_id") % 11
    rows = d.select(
        "doc_id", F.when(m == 0, -1).otherwise(F.col("doc_id")).alias("note_id"), F.when(m == 1, -1).otherwise(0).alias("chunk_index"), F.when(m == 2, " \n").otherwise(F.col("text")).alias("text"), F.lit(5).alias("start_offset"), F.when((m == 3) | (m == 9), 4).otherwise(5).alias("end_offset"),
        (T.chunk_word_count(F.col("text")) + F.when(m == 4, 1).otherwise(0)).alias("word_count"), (T.chunk_token_count(F.col("text")) + F.when(m == 5, 1).otherwise(0)).alias("token_count"), F.when(m == 6, "").otherwise("p").alias("parser_version"), F.when(m != 7, "h").alias("source_content_hash"), F.when((m == 8) | (m == 9), " ").otherwise("v").alias("chunking_version"),
    )
    return C.invalid(rows).select("doc_id", F.array_join("broken", ",").alias("broken"))


_GEN = """g AS (SELECT event_id AS query_id, CASE WHEN event_id % 11 = 0 THEN 'no connection' WHEN event_id % 7 = 0 THEN 'refused or empty answer' WHEN event_id % 5 = 0 THEN 'judge failed' WHEN event_id % 101 > 100 - 3 THEN 'a score is not from 0 to 1' END AS reason, (event_id % 101) / 97.0 AS f, (event_id % 13) / 12.0 AS r FROM events)"""


@query(f"WITH {_GEN} SELECT query_id, reason IS NOT NULL AS skipped, coalesce(reason, 'scored') AS reason, round(CASE WHEN reason IS NULL THEN f ELSE -1 END, 6)::double AS faithfulness, round(CASE WHEN reason IS NULL THEN r ELSE -1 END, 6)::double AS answer_relevancy FROM g")
def generation_scoring(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        i.alias("query_id"), F.when(i % 11 == 0, "no connection").alias("call_error"), (i % 7 == 0).alias("refused"), F.lit(None).cast("string").alias("refusal_reason"), F.lit("made").alias("answer"), F.when(i % 5 == 0, "judge failed").alias("judge_error"),
        ((i % 101) / 97).alias("faithfulness"), ((i % 13) / 12).alias("answer_relevancy"), F.lit(0.5).alias("context_precision"), F.lit(0.5).alias("context_recall"),
    )
    out = E.score_generation(rows).select("query_id", "skipped", F.coalesce("reason", F.lit("scored")).alias("reason"), F.coalesce("faithfulness", F.lit(-1.0)).alias("faithfulness"), F.coalesce("answer_relevancy", F.lit(-1.0)).alias("answer_relevancy"))
    return out.withColumns({c: F.round(c, 6) for c in ("faithfulness", "answer_relevancy")})


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id % 6 WHEN 1 THEN 3 ELSE -1 END::bigint AS faithfulness, CASE event_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE -1 END::bigint AS answer_relevancy,
 CASE event_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'not an object' WHEN 4 THEN 'faithfulness is not a whole number' WHEN 5 THEN 'faithfulness is not a whole number' WHEN 6 THEN 'answer_relevancy is not from 0 to 5' ELSE 'answer_relevancy is not a whole number' END AS error FROM events""")
def judge_scores(spark, sf_dir):
    """Replies made of the events' ids: whole numbers, whole floats, no JSON, a list, a fraction, a text, one out of range, a missing field."""
    from marginalia.functions.policies import judge_scores as scores

    i = F.col("event_id")
    f = (i % 6).cast("string")
    forms = [F.concat(F.lit('{"faithfulness": '), f, F.lit(', "answer_relevancy": 5}')), F.lit('{"faithfulness": 3.0, "answer_relevancy": 4}'), F.lit("fine, I think"), F.lit("[1, 2]"), F.lit('{"faithfulness": 2.5, "answer_relevancy": 4}'), F.lit('{"faithfulness": "3", "answer_relevancy": true}'), F.lit('{"faithfulness": 1, "answer_relevancy": 6}'), F.lit('{"faithfulness": 1}')]
    rows = table(spark, sf_dir, "events").select("event_id", scores(F.get(F.array(*forms), (i % 8).cast("int"))).alias("s"))
    return rows.select("event_id", F.coalesce("s.faithfulness", F.lit(-1)).alias("faithfulness"), F.coalesce("s.answer_relevancy", F.lit(-1)).alias("answer_relevancy"), F.coalesce("s.error", F.lit("none")).alias("error"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::bigint AS step, (event_id % 3 = 0)::bigint AS hit, substr(sha256(concat('prompt ', event_id)), 1, 16) AS prompt_hash FROM events")
def query_artifacts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 3 == 0).alias("hit"))
    prompt = F.concat(F.lit("prompt "), F.col("event_id").cast("string"))
    return E.query_artifacts(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "step", "hit", E.prompt_hash(prompt).alias("prompt_hash"))
