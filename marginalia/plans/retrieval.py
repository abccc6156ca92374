"""Search over documents (lexical) and embeddings (dense)."""

from pyspark.sql import functions as F

from marginalia.operators import retrieval as R
from marginalia.plans.registry import query, table

_BM25 = r"""d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents {where}), n AS (SELECT count(*) AS n FROM d),
p AS (SELECT doc_id, len(ts) AS n_terms, unnest(ts) AS term FROM d), post AS (SELECT doc_id, term, any_value(n_terms) AS n_terms, count(*) AS tf FROM p GROUP BY doc_id, term),
qs AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM benchmark), q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(ts) AS term FROM qs)),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, n WHERE term IN (SELECT term FROM q) GROUP BY term, n),
sc AS (SELECT q.item_id AS query_id, post.doc_id AS chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / 191.0))), 4) AS score FROM q JOIN idf USING (term) JOIN post USING (term) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc)"""
_LEX = "WITH " + _BM25.replace("{where}", "")
_DENSE = """qv AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT query_id, vec_id AS chunk_id, label::bigint AS label, round(list_sum(list_transform(range(1, 65), lambda i: qe[i]::double * embedding[i]::double)), 6) AS score FROM qv, embeddings {where}),
de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""
_VEC = "WITH " + _DENSE.replace("{where}", "")


def lexical(spark, sf_dir, k, **equal):
    docs = R.payload_filter(table(spark, sf_dir, "documents"), equal)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_top(queries, R.postings(docs, "doc_id"), docs.agg(F.count(F.lit(1)).alias("n")), k)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def dense(spark, sf_dir, k, **equal):
    chunks = vectors(spark, sf_dir)
    queries = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return R.dense(queries, R.payload_filter(chunks, equal), k)


@query(_LEX + " SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir, 10)


@query("WITH " + _BM25.replace("{where}", "WHERE lang = 'en' AND source = 'src3'") + " SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_filtered(spark, sf_dir):
    return lexical(spark, sf_dir, 10, lang="en", source="src3")


@query(_VEC + " SELECT query_id, chunk_id, score, rank FROM de WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return dense(spark, sf_dir, 10)


@query("WITH " + _DENSE.replace("{where}", "WHERE label = 3") + " SELECT query_id, chunk_id, score, rank FROM de WHERE rank <= 10")
def dense_filtered(spark, sf_dir):
    return dense(spark, sf_dir, 10, label=3)


_HYBRID = _LEX + ", " + _DENSE.replace("{where}", "") + """, l AS (SELECT query_id * 100 AS query_id, chunk_id, score, rank FROM bm WHERE rank <= 20), d2 AS (SELECT query_id, chunk_id, score, rank FROM de WHERE rank <= 20),
u AS (SELECT *, 1 AS list FROM d2 UNION ALL SELECT *, 2 FROM l), f AS (SELECT query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) AS score, max(CASE WHEN list = 1 THEN score END) AS score_1, max(CASE WHEN list = 2 THEN score END) AS score_2, min(list)::bigint AS first_list FROM u GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f)"""


def hybrid(spark, sf_dir, k):
    """Dense hits of a vector and lexical hits of the item of a hundredth of its number, over the same ids."""
    lexical_hits = lexical(spark, sf_dir, 20).withColumn("query_id", F.col("query_id") * 100)
    return R.fuse(dense(spark, sf_dir, 20), lexical_hits, k=k)


@query(_HYBRID + " SELECT query_id, chunk_id, score, coalesce(score_1, -1) AS score_1, coalesce(score_2, -1) AS score_2, first_list, rank FROM fused WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    return hybrid(spark, sf_dir, 10).na.fill(-1.0, ["score_1", "score_2"])


@query(_LEX + " SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 5")
def rerank_identity(spark, sf_dir):
    return R.rerank(lexical(spark, sf_dir, 20), 5)


@query(_LEX + ", c AS (SELECT bm.*, d.n_chars FROM bm JOIN documents d ON d.doc_id = bm.chunk_id WHERE rank <= 20), r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY n_chars % 7 DESC, rank) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def rerank_model(spark, sf_dir):
    """A stand-in for a pair model: the length of the text modulo 7."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text"))
    rows = lexical(spark, sf_dir, 20).join(texts, "chunk_id").withColumn("model", R.model_score(lambda q, t: [len(x) % 7 for x in t])(F.col("text"), F.col("text")))
    return R.rerank(rows, 5, F.col("model")).select("query_id", "chunk_id", "score", "rank")


@query(_VEC + ", h AS (SELECT query_id, label AS note_id, min(rank) AS chunk_rank FROM de WHERE rank <= 50 GROUP BY ALL) SELECT query_id, note_id, chunk_rank, row_number() OVER (PARTITION BY query_id ORDER BY chunk_rank, note_id) AS rank FROM h")
def note_collapse(spark, sf_dir):
    labels = vectors(spark, sf_dir).select("chunk_id", F.col("label").alias("note_id"))
    return R.collapse(dense(spark, sf_dir, 50).join(labels, "chunk_id"))


@query("SELECT vec_id AS chunk_id, len(embedding)::bigint AS dimension, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) AS norm, len(embedding) = 64 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) <= 1e-4 AS valid FROM embeddings")
def vector_validation(spark, sf_dir):
    from marginalia.operators.embedding import validity

    return validity(vectors(spark, sf_dir), 64)


@query("SELECT label::bigint AS label, count(*) AS vectors, round(avg(n), 6) AS mean_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, (count(*) * 64 * 4)::bigint AS vector_bytes FROM (SELECT label::bigint AS label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS n FROM embeddings) GROUP BY 1")
def embedding_norms(spark, sf_dir):
    from marginalia.operators.embedding import norms

    return norms(vectors(spark, sf_dir), "label")


@query("""WITH s AS (SELECT vec_id, label, vec_id % 97 = 0 AS gone, CASE WHEN vec_id % 89 = 0 THEN label + 1 ELSE label END AS label2 FROM embeddings), a AS (SELECT vec_id, label FROM s), b AS (SELECT vec_id, label2 AS label FROM s WHERE NOT gone UNION ALL SELECT -1 - vec_id, label FROM s WHERE gone)
SELECT coalesce(a.vec_id, b.vec_id) AS chunk_id, CASE WHEN b.vec_id IS NULL THEN 'missing' WHEN a.vec_id IS NULL THEN 'extra' ELSE 'label' END AS difference FROM a FULL JOIN b USING (vec_id) WHERE a.vec_id IS NULL OR b.vec_id IS NULL OR a.label IS DISTINCT FROM b.label""")
def store_consistency(spark, sf_dir):
    from marginalia.operators.embedding import consistency

    stored = vectors(spark, sf_dir).select("chunk_id", "label")
    gone = F.col("chunk_id") % 97 == 0
    points = stored.select(F.when(gone, -1 - F.col("chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(~gone & (F.col("chunk_id") % 89 == 0), F.col("label") + 1).otherwise(F.col("label")).alias("label"))
    return consistency(stored, points, ["label"])


@query(_HYBRID + """ SELECT 'dense' AS method, query_id, chunk_id, score, rank FROM de WHERE rank <= 5 UNION ALL SELECT 'bm25', query_id * 100, chunk_id, score, rank FROM bm WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, chunk_id, score, rank FROM fused WHERE rank <= 5""")
def search_methods(spark, sf_dir):
    from marginalia.sources.storage import settle

    most = settle(dense(spark, sf_dir, 20), "dense"), settle(lexical(spark, sf_dir, 20).withColumn("query_id", F.col("query_id") * 100), "lexical")  # what the fusion draws on holds the others
    parts = [R.search(m, 5, lambda k: most[0].where(F.col("rank") <= k), lambda k: most[1].where(F.col("rank") <= k)).select(F.lit(m).alias("method"), "query_id", "chunk_id", "score", "rank") for m in ("dense", "bm25", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_VEC + " SELECT query_id, chunk_id, score, rank FROM de WHERE rank <= 10")
def dense_cells(spark, sf_dir):
    """The hits of ``dense_topk`` from an index of cells, whatever they let the search skip."""
    from marginalia.operators import cells

    rows = vectors(spark, sf_dir)
    queries = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return cells.search(queries, cells.build(rows), 10)[0]


@query(_LEX + " SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def bm25_stored(spark, sf_dir):
    """The hits of ``bm25_topk`` from a stored index, whatever its bounds let the search skip."""
    from marginalia.operators import postings

    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.search(queries, postings.build(table(spark, sf_dir, "documents"), id_col="doc_id"), 10)
