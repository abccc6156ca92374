"""Search over cells against search over everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import cells, retrieval as R


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], i % 3) for i, x in rows], "chunk_id long, vector array<float>, part int").repartition(5)


def clustered(n, seed=1, dimension=8, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dimension))
    x = middle[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dimension))
    return [(i, v.astype(np.float32)) for i, v in enumerate(x)]


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("spread,k,n_cells", [(0.05, 5, 24), (3.0, 5, None), (0.05, 400, 7), (0.05, 1, 1)])
def test_equals_search_over_everything(spark, spread, k, n_cells):
    rows = vectors(spark, clustered(600, spread=spread))
    queries = rows.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    index = cells.build(rows, n_cells=n_cells)
    got, read = cells.search(queries, index, k)
    assert hits(got) == hits(R.dense(queries, rows, k))
    assert 0 < read["cells_read"] <= 1 and 0 < read["rows_scored"] <= 1


def test_reads_few_cells_where_vectors_cluster(spark):
    rows = vectors(spark, clustered(2000))
    queries = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    _, read = cells.search(queries, cells.build(rows, n_cells=40), 5)
    assert read["cells_read"] < 0.3 and read["rows_scored"] < 0.2


def test_blocks_stored_index_and_filter(spark, tmp_path):
    rows = vectors(spark, clustered(500))
    queries = rows.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    cells.build(rows, str(tmp_path / "index"), n_cells=9)
    index = cells.load(spark, str(tmp_path / "index"))
    want = hits(R.dense(queries, rows, 4))
    assert hits(cells.search(queries, index, 4, block_bytes=600)[0]) == want
    assert hits(cells.search(queries, index, 4, where=F.col("part") == 1)[0]) == hits(R.dense(queries, rows.where("part = 1"), 4))


def test_hard_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None), (42, []), (43, [1.0, 2.0]), (44, [-1.0, 0.0, 0.0]), (44, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "chunk_id long, vector array<float>, part int")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0]), (4, None), (5, [-2.0, 0.0, 0.0])], "query_id long, vector array<float>")
    got = hits(cells.search(queries, cells.build(df), 3)[0])
    assert got == [(1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (2, 1, 0, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0), (5, 1, 44, 2.0), (5, 2, 44, 2.0), (5, 3, 40, 0.0)]
    assert cells.search(queries, cells.build(df.limit(0)), 3)[0].count() == 0
    assert cells.search(queries.limit(0), cells.build(df), 3)[0].count() == 0


def test_brute_search_in_blocks(spark, monkeypatch):
    rows = vectors(spark, clustered(300))
    queries = rows.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    want = hits(R.dense(queries, rows, 4))
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 700)
    found = R.dense(queries, rows, 4)
    assert hits(found) == want and "MapInPandas" not in found._jdf.queryExecution().toString()  # each block was written before the next
