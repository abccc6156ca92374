"""A stored lexical index: blocks of postings with impact bounds, and exact top-k search that skips blocks by them.

A posting's impact is its BM25 weight without the IDF. A task counts the terms of its chunks and packs each term's postings, best first, in blocks that carry their largest impact; blocks, not postings, are dealt out by ranges of
(bucket of the term, term, falling impact), so a term of any size is spread over tasks, and small blocks of a term that meet are packed anew. Buckets are folders: a search reads those of its terms only, and no document.

Search (for all queries at once):

1. The first blocks of each term give every document they name a score from below; the k-th best is the query's threshold.
2. A term's best possible weight is its IDF times its largest impact. In rising order of these, the terms whose sum stays below the threshold cannot lift a document on their own; the others
   are essential. A block of a term is skipped if its bound and the best of all other terms together stay below the threshold.
3. The essential terms' remaining blocks give the candidates; those that the other terms could not lift to the threshold go. Postings of the other terms count for candidates only.

Bounds are from above and the threshold from below, so the k best are those of a search of all postings.

Cases: null and empty texts hold no term, but count as chunks. A chunk without an id is not found. Rows of one id have postings of their own, whose weights add up. An empty table gives an empty index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.operators import retrieval as R
from marginalia.sources.storage import new_folder, settle

BLOCK, BUCKETS = 128, 64
_SLACK = 1e-3  # scores are rounded to four digits


@dataclass(frozen=True)
class StoredIndex:
    """blocks: bucket, term, impact (largest), n, first (of its task), ids, tf, n_terms; terms: term, df, impact; size: one row with n, the number of chunks."""

    folder: str
    blocks: DataFrame
    terms: DataFrame
    size: DataFrame
    average: float


def _weight(average: float):
    return F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("n_terms") / average))


def _bucket(n: int):
    return F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")


SCHEMA = "bucket int, term string, impact double, n int, first boolean, ids array<long>, tf array<long>, n_terms array<int>"


def _cut(terms: pa.Array, ids: pa.Array, tf: np.ndarray, n_terms: np.ndarray, average: float, size: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Blocks of postings: the place of each block's first posting in the order (term by term as they come, best first), its impact, its lists, and its place in its term."""
    coded = terms.dictionary_encode()
    codes = np.asarray(coded.indices)
    weight = tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * n_terms / average))
    order = np.lexsort((-weight, codes))
    codes, weight = codes[order], weight[order]
    run = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    place = np.arange(len(codes)) - np.repeat(run, np.diff(np.concatenate((run, [len(codes)]))))
    start = np.flatnonzero(place % size == 0)
    offsets = pa.array(np.concatenate((start, [len(codes)])), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(order)), pa.array(tf[order], pa.int64()), pa.array(n_terms[order], pa.int32()))]
    return order[start], weight[start], lists, place[start]


def _counted(average: float, size: int):
    """The postings of a batch of chunks, already in blocks: term, impact, ids, tf, n_terms."""
    schema = pa.schema([("term", pa.string()), ("impact", pa.float64()), ("ids", pa.list_(pa.int64())), ("tf", pa.list_(pa.int64())), ("n_terms", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tf, ids, sizes, kinds = [], [], [], [], []
            for i, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words.as_py() or []
                if own:
                    found = Counter(own)
                    terms.extend(found)
                    tf.extend(found.values())
                    ids.append(i)
                    sizes.append(len(own))
                    kinds.append(len(found))
            if terms:
                column = pa.array(terms, pa.string())
                first, impact, lists, _ = _cut(column, pa.array(np.repeat(np.array(ids, np.int64), kinds)), np.array(tf, np.int64), np.repeat(np.array(sizes, np.int64), kinds), average, size)
                yield pa.RecordBatch.from_arrays([column.take(pa.array(first)), pa.array(impact), *lists], schema=schema)

    return count


def _pack(average: float, size: int):
    """Blocks of the sorted smaller blocks of a task."""
    schema = pa.schema([("bucket", pa.int32()), ("term", pa.string()), ("impact", pa.float64()), ("n", pa.int32()), ("first", pa.bool_()), ("ids", pa.list_(pa.int64())), ("tf", pa.list_(pa.int64())), ("n_terms", pa.list_(pa.int32()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last term of the batch before
        for batch in batches:
            if not len(batch):
                continue
            n = np.diff(np.asarray(batch.column("ids").offsets))
            row = np.repeat(np.arange(len(batch)), n)
            flat = [batch.column(c).flatten() for c in ("ids", "tf", "n_terms")]
            posting_terms = batch.column("term").take(pa.array(row))
            start, impact, lists, place = _cut(posting_terms, flat[0], np.asarray(flat[1]), np.asarray(flat[2]).astype(np.int64), average, size)
            terms, first = posting_terms.take(pa.array(start)), place == 0
            if before is not None and terms[0].as_py() == before:
                first[0] = False
            before = batch.column("term")[len(batch) - 1].as_py()
            sizes = np.diff(np.asarray(lists[0].offsets))
            yield pa.RecordBatch.from_arrays([batch.column("bucket").take(pa.array(row[start])), terms, pa.array(impact), pa.array(sizes, pa.int32()), pa.array(first), *lists], schema=schema)

    return pack


def build(chunks: DataFrame, folder: str | None = None, id_col: str = "chunk_id", text_col: str = "text", average: float = R.AVERAGE_WORDS, block: int = BLOCK, buckets: int = BUCKETS) -> StoredIndex:
    """Index the texts of chunks and store the index."""
    folder = folder or new_folder(chunks.sparkSession, "index")
    words = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("chunk_id"), R.terms(F.col(text_col)).alias("words"))
    parts = words.mapInArrow(_counted(average, block), "term string, impact double, ids array<long>, tf array<long>, n_terms array<int>").withColumn("bucket", _bucket(buckets))
    dealt = parts.repartitionByRange("bucket", "term", F.col("impact").desc(), F.xxhash64(F.get("ids", F.lit(0)))).sortWithinPartitions("bucket", "term", F.col("impact").desc())
    blocks = dealt.mapInArrow(_pack(average, block), SCHEMA)
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/blocks")
    chunks.agg(F.count(F.lit(1)).alias("n"), F.lit(float(average)).alias("average"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/size")
    stored = _blocks(chunks.sparkSession, folder)
    stored.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("impact").alias("best")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    return load(chunks.sparkSession, folder)


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("term string, impact double, n int, first boolean, ids array<long>, tf array<long>, n_terms array<int>, bucket int").parquet(f"{folder}/blocks")


def load(spark: SparkSession, folder: str) -> StoredIndex:
    """An index that was stored before."""
    terms = spark.read.schema("term string, df long, best double, bucket int").parquet(f"{folder}/terms")
    size = spark.read.parquet(f"{folder}/size")
    return StoredIndex(folder, _blocks(spark, folder), terms, size, size.first()["average"])


def asked(queries: DataFrame, index: StoredIndex) -> DataFrame:
    """query_id, term, bucket, idf, best (possible weight) of the different terms of each query (query_id, text) that the index holds."""
    buckets = index.size.first()["buckets"]
    own = queries.select("query_id", F.explode(F.array_distinct(R.terms(F.col("text")))).alias("term")).withColumn("bucket", _bucket(buckets))
    found = own.join(index.terms, ["bucket", "term"]).crossJoin(index.size.select("n"))  # one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return settle(found.select("query_id", "term", "bucket", idf.alias("idf"), (idf * F.col("best")).alias("best"), "df"), "asked")


def needed(own: DataFrame, least: DataFrame) -> DataFrame:
    """``asked`` with the query's threshold, whether a term is essential, and what its other terms could add. ``least``: query_id, least."""
    rising = W.partitionBy("query_id").orderBy("best", "term").rowsBetween(W.unboundedPreceding, 0)
    rows = own.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - F.lit(_SLACK))
    rows = rows.withColumns({"upto": F.sum("best").over(rising), "every": F.sum("best").over(W.partitionBy("query_id"))})
    rows = rows.withColumn("essential", F.col("upto") >= F.col("least"))
    others = F.sum(F.when(~F.col("essential"), F.col("best")).otherwise(0.0)).over(W.partitionBy("query_id"))
    return rows.withColumn("rest", F.col("every") - F.col("best")).withColumn("lift", others)


def blocks_of(own: DataFrame, blocks: DataFrame, buckets: list[int]) -> DataFrame:
    """Blocks of asked terms, in the folders of their buckets."""
    return blocks.where(F.col("bucket").isin(buckets)).join(own, ["bucket", "term"])


def _scores(found: DataFrame, average: float, *columns: str) -> DataFrame:
    rows = found.select("query_id", "idf", *columns, F.explode(F.arrays_zip("ids", "tf", "n_terms")).alias("p")).select("query_id", "idf", *columns, F.col("p.ids").alias("chunk_id"), F.col("p.tf").alias("tf"), F.col("p.n_terms").alias("n_terms"))
    return rows.select("query_id", "chunk_id", *columns, (F.col("idf") * _weight(average)).alias("weight"))


def search(queries: DataFrame, index: StoredIndex, k: int) -> DataFrame:
    """query_id, chunk_id, score (4 digits), rank: the k best chunks of each query."""
    own = asked(queries, index)
    buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    begun = _scores(blocks_of(own, index.blocks.where("first"), buckets), index.average).groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))
    least = R.top_k(begun, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    wanted = settle(needed(own, least), "wanted")
    found = blocks_of(wanted, index.blocks, buckets).where(F.col("idf") * F.col("impact") + F.col("rest") >= F.col("least"))
    first = _scores(found.where("essential"), index.average, "least", "lift").groupBy("query_id", "chunk_id", "least", "lift").agg(F.sum("weight").alias("weight"))
    candidates = settle(first.where(F.col("weight") + F.col("lift") >= F.col("least")).select("query_id", "chunk_id", "weight"), "candidates")
    others = _scores(found.where("NOT essential"), index.average).join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    scored = candidates.unionByName(others).groupBy("query_id", "chunk_id").agg(F.round(F.sum("weight"), 4).alias("score"))
    return R.top_k(scored, k).select("query_id", "chunk_id", "score", "rank")
