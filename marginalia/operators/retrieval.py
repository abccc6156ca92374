"""Dense, BM25 and hybrid search for many queries in one job, fusion and reranking.

Queries are the small side: they are joined to chunks by term, or taken in blocks that are broadcast, so chunks are scanned once and never shuffled
whole. Top-k per query is a ranked window, which Spark prunes before its shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.sources.storage import settle

K1, B, AVERAGE_WORDS, RRF_K = 1.2, 0.75, 191.0, 60
QUERY_BLOCK_BYTES = 8 << 20
HITS_BYTES = 32 << 20  # of the best hits that a task keeps
SUMS_BYTES = 8 << 20  # of a task's sums of scores
TILE_QUERIES, TILE_CHUNKS = 512, 1024
TERM_SALTS = 16
BROADCAST_TERMS, BROADCAST_HITS = 200_000, 200_000  # terms of queries, and hits, that are broadcast


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def top_k(scored: DataFrame, k: int, key: str = "chunk_id", score: str = "score") -> DataFrame:
    """rank (from 1) of the k best per query; ties by key."""
    w = W.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """term, chunk_id, tf, n_terms: the inverted index."""
    rows = chunks.select(F.col(id_col).alias("chunk_id"), terms(F.col(text_col)).alias("terms")).withColumn("n_terms", F.size("terms"))
    # an outer explode: before an inner one Spark filters by the array, and splits the text once more
    return rows.select("chunk_id", "n_terms", F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n_terms").alias("n_terms"))


def bm25(queries: DataFrame, index: DataFrame, n_chunks: DataFrame, average: float = AVERAGE_WORDS) -> DataFrame:
    """query_id, chunk_id, score (4 digits). ``queries``: query_id, text; ``n_chunks``: one row with n.

    Postings are cut to the queries' terms before anything else is counted, so only these terms' rows are shuffled; they are written once, for their
    counts and for the scores. Few queries are brought to the postings of each chunk, and its scores are summed where these are, so pairs of query and chunk
    are not shuffled; else a frequent term's postings are dealt to many places where they meet the queries that ask for it. ``bm25_top`` makes no row for each pair."""
    asked, found, idf = _asked(queries, index, n_chunks)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_terms") / average))
    if asked.count() <= BROADCAST_TERMS:
        asked = settle(asked.join(idf, "term"), "asked")
        return found.repartition("chunk_id").join(F.broadcast(asked), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 4).alias("score"))
    salts = F.array(*[F.lit(i) for i in range(TERM_SALTS)])
    asked = asked.join(idf, "term").withColumn("salt", F.explode(salts))
    scored = asked.join(found.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_SALTS)).cast("int")), ["term", "salt"])
    return scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 4).alias("score"))


def _asked(queries: DataFrame, index: DataFrame, n_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries' terms (query_id, term), their postings, both written, and term, idf."""
    asked = settle(queries.select("query_id", F.explode_outer(F.array_distinct(terms(F.col("text")))).alias("term")).where("term IS NOT NULL"), "asked")
    wanted = asked.select("term").distinct()
    found = settle(index.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted, "term", "left_semi"), "postings")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(n_chunks).select("term", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return asked, found, idf


def _sums(ids: np.ndarray, terms_: list[str], idf: np.ndarray, asking: list[np.ndarray], k: int, average: float):
    """The k best of a task's chunks for each query, from postings in the order of chunks. ``asking``: places of the queries that hold each term. Sums are held for a few chunks and all queries at a time."""
    most, names = max(1, SUMS_BYTES // 8 // max(1, len(ids))), pa.array(terms_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rest = _Best(len(ids), k), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rows = [np.asarray(batch.column("chunk_id")), np.asarray(pc.index_in(batch.column("term"), value_set=names)), np.asarray(batch.column("tf")), np.asarray(batch.column("n_terms"))]
                rest = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            starts = np.flatnonzero(np.concatenate(([True], rest[0][1:] != rest[0][:-1])))
            while len(starts) > most or batch is None and len(starts):
                end = int(starts[most]) if len(starts) > most else len(rest[0])
                chunk, term, tf, n_terms = (x[:end] for x in rest)
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / average))
                chunks, place = chunk[starts[:most]], np.searchsorted(starts[:most], np.arange(end), "right") - 1
                order = np.argsort(term, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], np.diff(term[order]) != 0)))
                sums = np.zeros((len(ids), len(chunks)))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), end], strict=True):
                    own = order[a:b]
                    sums[asking[term[own[0]]][:, None], place[own]] += weight[own]
                best.offer(0, sums, chunks, 4, 0.0)
                rest, starts = [x[end:] for x in rest], starts[most:] - end
        yield from best.batches(ids)

    return run


def bm25_top(queries: DataFrame, index: DataFrame, n_chunks: DataFrame, k: int, average: float = AVERAGE_WORDS) -> DataFrame:
    """The k best of ``bm25`` for each query, with their rank. Where queries are few, each task sums the scores of its own chunks and keeps k a query, so no row is made for a pair of query and chunk."""
    asked, found, idf = _asked(queries, index, n_chunks)
    n_terms, n_queries = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    if n_terms > BROADCAST_TERMS or n_queries * k * 16 > HITS_BYTES:
        return top_k(bm25(queries, index, n_chunks, average), k)
    rows = asked.join(idf, "term").select("query_id", "term", "idf").orderBy("term", "query_id").collect()  # at most BROADCAST_TERMS
    ids = np.array(sorted({r["query_id"] for r in rows}), np.int64)
    known = {r["term"]: r["idf"] for r in rows}
    at, asking = {t: i for i, t in enumerate(known)}, [[] for _ in known]
    for r in rows:
        asking[at[r["term"]]].append(r["query_id"])
    run = _sums(ids, list(known), np.array(list(known.values())), [np.searchsorted(ids, x) for x in asking], k, average)
    postings_ = found.select(F.col("chunk_id").cast("long").alias("chunk_id"), "term", F.col("tf").cast("double").alias("tf"), F.col("n_terms").cast("double").alias("n_terms"))
    return top_k(postings_.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(run, "query_id long, chunk_id long, score double") if rows else found.selectExpr("cast(0 AS long) AS query_id", "cast(chunk_id AS long) AS chunk_id", "0.0D AS score").where("false"), k)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 for empty vectors, null for unequal lengths."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def tiles(matrix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, slice, pa.RecordBatch]]:
    """Scores of all queries (rows of ``matrix``) and vectors in tiles that stay in cache: the tile's first query, scores, rows of the batch, the batch. A tile is free again when the next is asked for."""
    for batch in batches:
        x = np.asarray(batch.column("vector").flatten()).astype(np.float64).reshape(len(batch), matrix.shape[1]).T if len(batch) else None
        for c in range(0, len(batch), TILE_CHUNKS):
            part = slice(c, min(c + TILE_CHUNKS, len(batch)))
            for q in range(0, len(matrix), TILE_QUERIES):
                yield q, matrix[q : q + TILE_QUERIES] @ x[:, part], part, batch


class _Best:
    """The k best of what has passed, for each of n queries: at most a few times n k rows."""

    def __init__(self, n: int, k: int):
        self.k, self.most = k, max(2 * n * k, 1 << 18)
        self.least, self.last_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        least = self.least[query]
        keep = (score > least) | (score == least) & (chunk < self.last_id[query])
        self.waiting.append((query[keep], chunk[keep], score[keep]))
        self.n += int(keep.sum())
        if self.n > self.most:
            self.merge()

    def offer(self, first: int, got: np.ndarray, chunk: np.ndarray, digits: int, above: float = -np.inf) -> None:
        """Scores of queries from ``first`` on (rows) and chunks (columns), if above a bound."""
        slack = 10.0**-digits  # a rounded score is off by half of it
        least = self.least[first : first + len(got)] - slack
        if self.k < got.shape[1] and np.isneginf(least).any():
            least = np.maximum(least, np.partition(got, -self.k, axis=1)[:, -self.k] - 2 * slack)
        q, c = np.nonzero((got >= least[:, None]) & (got > above))
        self.add(q + first, chunk[c], np.round(got[q, c], digits))

    def batches(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.merge()
        query, chunk, score = self.kept
        for i in range(0, len(query), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query[part]]), pa.array(chunk[part]), pa.array(score[part])], names=["query_id", "chunk_id", "score"])

    def merge(self) -> None:
        query, chunk, score = (np.concatenate(x) for x in zip(self.kept, *self.waiting, strict=True))
        order = np.lexsort((chunk, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        query, order = query[place < self.k], order[place < self.k]
        self.kept, self.waiting, self.n = (query, chunk[order], score[order]), [], 0
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[query[last]], self.last_id[query[last]] = self.kept[2][last], self.kept[1][last]


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int, digits: int):
    """The k best of a task's rows for each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for first, got, own, batch in tiles(matrix, batches):
            best.offer(first, got, np.asarray(batch.column("chunk_id"))[own], digits)
        yield from best.batches(ids)

    return run


def dense(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact search: query_id, chunk_id, score, rank. ``queries``: query_id, vector; ``chunks``: chunk_id, vector.

    A block of queries is a set of a checked size, held against every chunk by matrix products of one tile after the other; each task keeps its own
    k best per query, a checked size too, so what is shuffled is k rows per query and task. Vectors of another length than a query's, and null ones, have no score.
    Search over stored cells (``cells``) need not read every chunk."""
    parts = []
    lengths = sorted(tuple(r) for r in queries.where("size(vector) > 0").groupBy(F.size("vector")).count().collect())
    blocks = [(d, block, n_blocks) for d, n in lengths for n_blocks in [max(n * d * 8 // QUERY_BLOCK_BYTES, n * k * 16 // HITS_BYTES) + 1] for block in range(n_blocks)]
    for dimension, block, n_blocks in blocks:
        own = queries.where(F.size("vector") == dimension)
        own = own if n_blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)
        rows = own.select("query_id", "vector").orderBy("query_id").collect()  # about QUERY_BLOCK_BYTES
        if not rows:
            continue
        ids, matrix = np.array([r["query_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64)
        scored = chunks.where(F.size("vector") == dimension).select(F.col("chunk_id").cast("long"), "vector").mapInArrow(_nearest(ids, matrix, k, digits), "query_id long, chunk_id long, score double")
        best = top_k(scored, k)
        parts.append(best if len(blocks) == 1 else settle(best, "hits"))  # a block's hits are written before the next one is read
    if not parts:
        return chunks.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_payload(ranked: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ranked hits with the columns of their chunks, written: they are few, while each use of the join would read all chunks again, or shuffle them."""
    ranked = settle(ranked, "ranked")
    return settle(chunks.join(F.broadcast(ranked) if ranked.count() <= BROADCAST_HITS else ranked, key), "hits")


def payload_filter(chunks: DataFrame, equal: dict) -> DataFrame:
    """Rows where each column equals a scalar."""
    for column, value in equal.items():
        if isinstance(value, (list, tuple, dict, set)) or value is None:
            raise TypeError(f"a filter on {column} needs a scalar")
        chunks = chunks.where(F.col(column) == F.lit(value))
    return chunks


def fuse(*ranked: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, chunk_id, rank, score): fused score, raw score of each list (score_1, ...), first list, rank."""
    rows = None
    for i, r in enumerate(ranked, 1):
        part = r.select("query_id", "chunk_id", "rank", "score", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    raw = [F.max(F.when(F.col("list") == i, F.col("score"))).alias(f"score_{i}") for i in range(1, len(ranked) + 1)]
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), *raw, F.min("list").alias("first_list"))
    return top_k(fused, k) if k else fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def rerank(ranked: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best by a second score (ties by the old rank), or the first k; ``score`` itself stays. Renumbered."""
    order = [F.col("rank")] if score is None else [score.desc(), F.col("rank")]
    new = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return ranked.withColumn("new_rank", new).where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def model_score(f: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column of a pair model's scores: f(queries, texts), a batch at a time."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(f(q.tolist(), t.tolist()), dtype="float64")

    return score


def search(method: str, top_k: int, dense_hits: Callable[[int], DataFrame], lexical_hits: Callable[[int], DataFrame], candidate_k: int = 20) -> DataFrame:
    """Ranked hits by dense, bm25 or hybrid search. Each part gives its k best; a fusion draws on ``candidate_k`` of each, and on no fewer than it returns."""
    if method == "dense":
        return dense_hits(top_k)
    if method == "bm25":
        return lexical_hits(top_k)
    if method != "hybrid":
        raise ValueError(f"no search method {method!r}")
    most = max(candidate_k, top_k)
    return fuse(dense_hits(most), lexical_hits(most), k=top_k)


def query_filters(configured: dict, source_path: str | None = None, note_id: int | None = None, version: str | None = None, lexical: bool = False) -> dict:
    """The filters of a query: those of the configuration, then path and note where given; lexical search also keeps to one chunking version."""
    own = {"source_path": source_path, "note_id": note_id, "chunking_version": version if lexical else None}
    return configured | {k: v for k, v in own.items() if v is not None}


def without_note(ranked: DataFrame, note_col: str = "note_id") -> DataFrame:
    """Queries that hit a chunk of no note, with the reason why they are skipped."""
    return ranked.where(F.col(note_col).isNull()).select("query_id", F.lit("missing_note_id").alias("reason")).distinct()


def collapse(ranked: DataFrame, note_col: str = "note_id") -> DataFrame:
    """The first chunk of each note, renumbered. A query with a chunk of no note has no ranking (see ``without_note``)."""
    missing = F.max(F.col(note_col).isNull()).over(W.partitionBy("query_id"))
    first = ranked.withColumn("missing", missing).where(~F.col("missing")).groupBy("query_id", note_col).agg(F.min("rank").alias("chunk_rank"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_rank", note_col)))
