"""Packing, gates, policies, the answer cache and the answering graph."""

from pyspark.sql import functions as F

from marginalia.functions import policies as P
from marginalia.operators import retrieval as R, serving as S
from marginalia.plans.registry import query, table
from marginalia.plans.retrieval import _LEX, lexical, vectors

_TOKENS = "ceil(length({t}) / 4)::bigint"
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_PACK = _LEX + rf""", c AS (SELECT bm.*, d.source, {_STRIP.format(t='d.text')} AS t FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE rank <= 10),
cut AS (SELECT * REPLACE (CASE WHEN rank = 1 AND {_TOKENS.format(t='t')} > 1200 THEN regexp_replace(t[1:4800], '\s+$', '') ELSE t END AS t) FROM c),
u AS (SELECT *, {_TOKENS.format(t='t')} AS tokens, sum({_TOKENS.format(t='t')}) OVER (PARTITION BY query_id ORDER BY rank)::bigint AS used FROM cut), packed AS (SELECT * FROM u WHERE used <= 1200 OR rank = 1)"""


def _hits(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    return R.with_payload(lexical(spark, sf_dir, 10), texts)


@query(_PACK + " SELECT query_id, chunk_id, rank, tokens, used, length(t)::bigint AS chars FROM packed")
def pack_context(spark, sf_dir):
    return S.pack(_hits(spark, sf_dir)).select("query_id", "chunk_id", "rank", "tokens", "used", F.length("text").alias("chars"))


@query(_LEX + ", b AS (SELECT query_id, max(score) AS best FROM bm WHERE query_id % 5 <> 0 GROUP BY query_id) SELECT item_id AS query_id, coalesce(CASE WHEN best IS NULL THEN 'no retrieved context' WHEN best < 60 THEN 'retrieved context is below the score threshold' END, 'none') AS refusal FROM benchmark LEFT JOIN b ON query_id = item_id")
def refuse_gate(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return S.gate(asked, lexical(spark, sf_dir, 10).where("query_id % 5 <> 0"), 60.0).na.fill("none", ["refusal"])


@query(_PACK + rf""", g AS (SELECT query_id, string_agg(concat('[chunk_id=', chunk_id, ' note_path=', source, '/', chunk_id, '.md title=', chunk_id, ']', chr(10), t), chr(10) ORDER BY rank) AS body FROM packed GROUP BY query_id)
SELECT item_id AS query_id, sha256(concat('Question: ', {_STRIP.format(t='text')}, chr(10), chr(10), 'Chunks:', chr(10), body)) AS prompt_hash FROM benchmark JOIN g ON query_id = item_id""")
def build_prompt(spark, sf_dir):
    packed = S.pack(_hits(spark, sf_dir)).select("query_id", "rank", "chunk_id", F.concat("source", F.lit("/"), F.col("chunk_id").cast("string"), F.lit(".md")).alias("note_path"), F.col("chunk_id").cast("string").alias("title"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return S.prompt(asked, packed).select("query_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query(rf"SELECT conv_id, turn, CASE WHEN length({_STRIP.format(t='text')}) < 3 OR NOT regexp_matches(text, '\p{{L}}') THEN 'refuse' ELSE 'rag_qa' END AS label, CASE WHEN length({_STRIP.format(t='text')}) < 3 THEN 'query too short' WHEN NOT regexp_matches(text, '\p{{L}}') THEN 'query has no letters' ELSE 'looks like a vault question' END AS reason FROM conversations")
def classify_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.query_label(F.col("text")).alias("label"), P.query_reason(F.col("text")).alias("reason"))


@query(rf"SELECT conv_id, turn, concat(trim(regexp_replace(text, '\s+', ' ', 'g')), CASE WHEN turn % 2 = 0 THEN ' {P.HINT}' ELSE '' END) AS rewritten FROM conversations WHERE role = 'user'")
def rewrite_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", P.rewritten(F.col("text"), F.col("turn") % 2).alias("rewritten"))


_CHECK = "CASE WHEN turn % 7 = 0 THEN 'refused path needs no answer check' WHEN trim(text) = '' THEN 'empty answer' WHEN (conv_id % 10) / 10.0 < 0.4 THEN 'low confidence' WHEN turn % 3 = 0 THEN 'missing citations' ELSE 'answer looks grounded' END"


@query(f"SELECT conv_id, turn, {_CHECK} AS reason, {_CHECK} IN ('refused path needs no answer check', 'answer looks grounded') AS ok FROM conversations WHERE role = 'assistant'")
def self_check(spark, sf_dir):
    a = (F.col("text"), (F.col("conv_id") % 10) / 10, F.col("turn") % 3, F.col("turn") % 7 == 0)
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", P.self_check_reason(*a).alias("reason"), P.self_check_ok(*a).alias("ok"))


_Q = "conv_id * 1000 + turn"


@query(f"""WITH q AS (SELECT {_Q} AS query_id, text, turn, conv_id, length(text) AS n FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN conv_id % 11 = 0 THEN 'semantic_cache_lookup' WHEN length(trim(text)) < 3 OR NOT regexp_matches(text, '\\p{{L}}') THEN 'semantic_cache_lookup>classify>refuse' WHEN query_id % 7 = 0 THEN 'semantic_cache_lookup>classify>retrieve>rerank>gate>refuse'
 WHEN query_id % 5 = 0 THEN 'semantic_cache_lookup>classify>retrieve>rerank>gate>generate>self_check>rewrite>retrieve>rerank>gate>generate>self_check>semantic_cache_write' ELSE 'semantic_cache_lookup>classify>retrieve>rerank>gate>generate>self_check>semantic_cache_write' END AS path,
 CASE WHEN conv_id % 11 = 0 THEN 0 WHEN length(trim(text)) < 3 OR NOT regexp_matches(text, '\\p{{L}}') OR query_id % 7 = 0 THEN 0 WHEN query_id % 5 = 0 THEN 1 ELSE 0 END::bigint AS retries FROM q""")
def generate_graph_trace(spark, sf_dir):
    """Stand-ins: a question of every seventh id finds nothing, one of every fifth needs a second attempt, every eleventh conversation is cached."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), "conv_id")
    cached = q.where("conv_id % 11 = 0").select("query_id", F.lit("known").alias("cached_answer"))
    retrieve = lambda rows: rows.select("query_id", F.when(F.col("query_id") % 7 == 0, -1.0).otherwise(1.0).alias("best"), F.lit("text").alias("context"))
    again = F.col("query").endswith(P.HINT)
    generate = lambda rows: rows.select("query_id", F.lit("made").alias("answer"), F.when((F.col("query_id") % 5 == 0) & ~again, 0.1).otherwise(0.9).alias("confidence"), F.lit(1).alias("n_citations"))
    return S.answer_graph(q.select("query_id", "query"), retrieve, generate, 0.0, cached).select("query_id", "path", "retries")


@query(_PACK + rf""", best_of AS (SELECT query_id, max(score) AS best FROM bm GROUP BY query_id), context_of AS (SELECT query_id, string_agg(chunk_id::varchar, ' ' ORDER BY rank) AS context, count(*) AS n FROM packed GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN length({_STRIP.format(t='text')}) < 3 OR NOT regexp_matches(text, '\p{{L}}') THEN 'semantic_cache_lookup>classify>refuse' WHEN coalesce(best, 0) < 60 THEN 'semantic_cache_lookup>classify>retrieve>rerank>gate>refuse'
 ELSE 'semantic_cache_lookup>classify>retrieve>rerank>gate>generate>self_check>semantic_cache_write' END AS path, CASE WHEN coalesce(best, 0) >= 60 THEN concat(n, ' chunks: ', context) ELSE 'none' END AS answer FROM benchmark LEFT JOIN best_of ON best_of.query_id = item_id LEFT JOIN context_of ON context_of.query_id = item_id""")
def generate_graph_bm25(spark, sf_dir):
    """The graph over real retrieval and packing: an answer names the chunks that were packed for it."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("chunk_id"), "text")

    def retrieve(asked):
        hits = R.with_payload(R.bm25_top(asked.select("query_id", F.col("query").alias("text")), R.postings(docs, "doc_id"), docs.agg(F.count(F.lit(1)).alias("n")), 10), texts)
        packed = S.pack(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))
        best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
        return best.join(packed.select("query_id", F.array_join(F.transform("c", lambda x: x["chunk_id"].cast("string")), " ").alias("context")), "query_id")

    def generate(found):
        n = F.size(F.split("context", " "))
        return found.select("query_id", F.concat(n.cast("string"), F.lit(" chunks: "), "context").alias("answer"), F.lit(0.9).alias("confidence"), n.alias("n_citations"))

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.answer_graph(asked, retrieve, generate, 60.0).select("query_id", "path", F.coalesce("answer", F.lit("none")).alias("answer"))


_SIM = "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::double * e.embedding[i]::double)), 6) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id % 100 <> 0 {more}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS n FROM s)"


@query(_SIM.format(more="") + " SELECT query_id, entry_id, similarity FROM r WHERE n = 1 AND similarity >= 0.3")
def cache_lookup(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return S.cache_lookup(v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), v.where("chunk_id % 100 <> 0").select(F.col("chunk_id").alias("entry_id"), "vector"), 0.3)


@query("SELECT event_type AS version, event_id AS entry_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > timestamp '2024-01-01') WHERE n <= 100")
def cache_lru(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("ts > timestamp_ntz '2024-01-01'").select(F.col("event_type").alias("version"), F.col("event_id").alias("entry_id"), F.col("ts").alias("last_used"))
    return S.cache_evict(rows, 100).select("version", "entry_id")


@query("WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type AS version, count(*) AS entries FROM events, m WHERE ts > t - INTERVAL 86400 SECONDS GROUP BY event_type")
def cache_ttl(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.col("event_id").alias("entry_id"), F.col("ts").alias("last_used"))
    rows = rows.crossJoin(rows.agg(F.max("last_used").alias("now")))  # one row
    return S.cache_evict(rows, 1 << 30, F.col("now"), 86400).groupBy("version").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE concat('x ', doc_id, ' \\approx') END AS answer, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 2 = 0 THEN concat(doc_id, ':', doc_id, '.md') ELSE '' END AS citations, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE least(doc_id / 500.0, 1) END::double AS confidence, doc_id % 3 = 0 AS failed FROM documents")
def parse_generation_json(spark, sf_dir):
    """Replies made of the documents' ids: fenced, with a stray backslash, with unknown citations; every third is not JSON."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    reply = F.when(F.col("doc_id") % 3 == 0, "no json here").otherwise(F.concat(F.lit('Sure:\n```json\n{"answer": "x '), F.col("doc_id").cast("string"), F.lit(' \\approx", "citations": [{"chunk_id": 1}, {"chunk_id": '), F.col("doc_id").cast("string"), F.lit('}], "confidence": '), (F.col("doc_id") / 500).cast("string"), F.lit("}\n```")))
    allowed = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id"))).otherwise(F.array(F.lit(-1).cast("long")))
    paths = F.map_from_arrays(allowed, F.transform(allowed, lambda x: F.concat(x.cast("string"), F.lit(".md"))))
    out = S.parse_answers(d.select(F.col("doc_id").alias("query_id"), reply.alias("reply"), allowed.alias("allowed"), paths.alias("note_paths")))
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["chunk_id"].cast("string"), c["note_path"])), ",")
    return out.select("query_id", F.coalesce("answer", F.lit("none")).alias("answer"), cited.alias("citations"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), F.col("error").isNotNull().alias("failed"))


_GRID = _LEX + rf""", budgets AS (SELECT unnest([400, 1200, 3000])::bigint AS budget), c AS (SELECT bm.*, d.source, {_STRIP.format(t='d.text')} AS t FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE rank <= 10),
cut AS (SELECT c.* REPLACE (CASE WHEN rank = 1 AND {_TOKENS.format(t='t')} > budget THEN regexp_replace(t[1:budget * 4], '\s+$', '') ELSE t END AS t), budget FROM c, budgets),
u AS (SELECT *, {_TOKENS.format(t='t')} AS tokens, sum({_TOKENS.format(t='t')}) OVER (PARTITION BY query_id, budget ORDER BY rank)::bigint AS used FROM cut), packed AS (SELECT * FROM u WHERE used <= budget OR rank = 1),
nt AS (SELECT query_id, budget, source AS key, min(rank) AS r FROM packed GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, budget ORDER BY r) AS rank FROM nt), gold AS (SELECT item_id AS query_id, concat('src', unnest([item_id % 20, (item_id + 1) % 20, (item_id + 2) % 20])) AS key FROM benchmark),
ns AS (SELECT query_id, budget, sum(CASE WHEN gold.key IS NOT NULL AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN gold.key IS NOT NULL AND rank <= 5 THEN rank END) AS first FROM rk LEFT JOIN gold USING (query_id, key) GROUP BY ALL),
sz AS (SELECT query_id, budget, count(*) AS packed_chunks, sum(tokens)::bigint AS est_tokens FROM packed GROUP BY ALL)"""


@query(_GRID + " SELECT query_id, budget, packed_chunks, est_tokens, round(dcg / (1 + 1 / log2(3) + 1 / log2(4)), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM ns JOIN sz USING (query_id, budget)")
def budget_grid(spark, sf_dir):
    """Three budgets for every question; a source stands for a note, three sources are a question's gold."""
    from marginalia.operators.experiments import budget_grid as grid

    i = F.col("item_id")
    gold = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.explode(F.array(*[F.concat(F.lit("src"), ((i + k) % 20).cast("string")) for k in range(3)])).alias("key"))
    return grid(_hits(spark, sf_dir).withColumnRenamed("source", "key"), gold, [400, 1200, 3000], 5)


@query("""WITH s AS (SELECT p.vec_id AS query_id, c.vec_id AS entry_id, round(list_sum(list_transform(range(1, 65), lambda i: p.embedding[i]::double * c.embedding[i]::double)), 6) AS similarity FROM embeddings p, embeddings c WHERE p.vec_id % 100 IN (1, 2, 3) AND c.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS n FROM s), h AS (SELECT * FROM r WHERE n = 1 AND similarity >= 0.2)
SELECT vec_id // 100 AS group_id, vec_id AS query_id, 'canonical' AS pass, false AS hit, -1::bigint AS entry_id FROM embeddings WHERE vec_id % 100 = 0
UNION ALL SELECT vec_id // 100, vec_id, 'paraphrase', h.entry_id IS NOT NULL, coalesce(h.entry_id, -1) FROM embeddings LEFT JOIN h ON h.query_id = vec_id WHERE vec_id % 100 IN (1, 2, 3)""")
def cache_two_pass(spark, sf_dir):
    """Vectors of the first of each hundred stand for canonical queries, of the next three for paraphrases."""
    from marginalia.operators.experiments import two_pass

    v = vectors(spark, sf_dir).select(F.floor(F.col("chunk_id") / 100).alias("group_id"), F.col("chunk_id").alias("query_id"), "vector")
    return two_pass(v.where("query_id % 100 = 0"), v.where("query_id % 100 IN (1, 2, 3)"), 0.2).select("group_id", "query_id", "pass", "hit", F.coalesce("entry_id", F.lit(-1)).alias("entry_id"))
