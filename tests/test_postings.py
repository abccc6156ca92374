"""Search of stored postings against search of all of them."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from marginalia.operators import postings, retrieval as R

_R = random.Random(4)
WORDS = ["".join(_R.choice("abcdefgh") for _ in range(_R.randint(2, 5))) for _ in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(WORDS[min(int(r.expovariate(0.015)), 499)] for _ in range(n))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, prose(random.Random(i).randint(3, 150), i)) for i in range(500)] + [(600 + i, prose(40, 3)) for i in range(30)] + [(700, None), (701, ""), (702, "a-b . ,"), (None, "zz")]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, prose(1 + i % 12, 1000 + i)) for i in range(40)] + [(50, None), (51, ""), (52, "nowhere"), (53, prose(40, 3))], "query_id long, text string")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def everything(queries, chunks, k):
    return hits(R.top_k(R.bm25(queries, R.postings(chunks.where("chunk_id IS NOT NULL")), chunks.agg(F.count(F.lit(1)).alias("n"))), k))


@pytest.mark.parametrize("k,block", [(5, 128), (3, 4), (100, 16)])
def test_equals_search_of_all_postings(chunks, queries, k, block):
    assert hits(postings.search(queries, postings.build(chunks, block=block, buckets=8), k)) == everything(queries, chunks, k)


def test_a_stored_index_needs_no_document(spark, chunks, queries, tmp_path):
    chunks.write.parquet(str(tmp_path / "chunks"))
    want = everything(queries, chunks, 4)
    postings.build(spark.read.parquet(str(tmp_path / "chunks")), str(tmp_path / "index"), block=8)
    shutil.rmtree(tmp_path / "chunks")
    assert sorted(os.listdir(tmp_path)) == ["index"]
    assert hits(postings.search(queries, postings.load(spark, str(tmp_path / "index")), 4)) == want


def test_bounds_skip_blocks_and_terms(chunks, queries, spark):
    index = postings.build(chunks, block=4)
    own = postings.asked(queries, index)
    kth = spark.createDataFrame([(q, s) for q, r, _, s in everything(queries, chunks, 1) if r == 1], "query_id long, least double")
    wanted = postings.needed(own, kth)
    buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]
    every = postings.blocks_of(wanted, index.blocks, buckets)
    kept = every.where(F.col("idf") * F.col("impact") + F.col("rest") >= F.col("least"))
    n = lambda rows: rows.agg(F.sum("n")).first()[0]
    assert n(kept) < n(every) and n(kept.where("essential")) < 0.7 * n(every)


def test_blocks_are_bounded_and_best_first(chunks):
    index = postings.build(chunks, block=4)
    rows = index.blocks.collect()
    for r in rows:
        assert r["n"] == len(r["ids"]) == len(r["tf"]) == len(r["n_terms"]) <= 4
        weights = [t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / 191.0)) for t, n in zip(r["tf"], r["n_terms"])]
        assert abs(max(weights) - r["impact"]) < 1e-9 and weights == sorted(weights, reverse=True)
    assert {r["term"] for r in rows if r["first"]} == {r["term"] for r in rows}
    assert sum(r["n"] for r in rows) == R.postings(chunks.where("chunk_id IS NOT NULL")).count()


def test_empty_tables(chunks, queries):
    assert postings.search(queries, postings.build(chunks.limit(0)), 3).count() == 0
    assert postings.search(queries.limit(0), postings.build(chunks), 3).count() == 0
