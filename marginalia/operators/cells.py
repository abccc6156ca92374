"""Exact dense search over cells: cells and stretches of them that cannot hold one of the k best are not read.

An index keeps every vector in the cell of its nearest centre, with its distance d from the centre. For a query q and a vector x of a cell with centre c, q.x <= q.c + |q| d, so a cell of radius r
cannot beat a k-th best score t where q.c + |q| r < t. Centres come from a bounded sample and only decide how much is skipped; every vector is indexed, bounds are from above, and what is left is
scored in full, so the result is that of a search of everything.

Rows are stored by cell and falling distance, a large cell in many pieces, so a scan for some cells reads their row groups only. Queries are taken in blocks of a checked size; each block is written
before the next one begins, and each task keeps its own k best per query.

Cases: null vectors, and vectors of another length than the index has, have no score. Repeated rows are found as often as they stand. An empty table gives an empty index, and empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from marginalia.operators.retrieval import QUERY_BLOCK_BYTES, top_k
from marginalia.sources.storage import new_folder, settle

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 2048, 10
_SLACK = 1e-6


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), dimension)


def centres(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means centres of a sample; a centre that loses its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = nearest_centre(sample, found)
        sums, counts = np.zeros_like(found), np.bincount(nearest, minlength=len(found))
        np.add.at(sums, nearest, sample)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest_centre(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.argmax(x @ found.T - (found**2).sum(1) / 2, axis=1)


@dataclass(frozen=True)
class CellIndex:
    """Stored rows (chunk_id, vector, cell, distance and the payload) and, in the driver, one centre, size and radius a cell (at most MOST_CELLS)."""

    rows: DataFrame
    folder: str
    centre: np.ndarray
    size: np.ndarray
    radius: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centre.shape[1]


def build(vectors: DataFrame, folder: str | None = None, n_cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """Index vectors (chunk_id, vector, payload columns). ``n_cells``: about the square root of their number if not given."""
    spark = vectors.sparkSession
    folder = folder or new_folder(spark, "cells")
    valid = vectors.where("vector IS NOT NULL AND size(vector) > 0")
    total, dimension = valid.agg(F.count(F.lit(1)), F.mode(F.size("vector"), True)).first()
    if not total:
        vectors.withColumns({"cell": F.lit(0), "distance": F.lit(0.0)}).where("false").write.mode("overwrite").parquet(f"{folder}/rows")
        spark.createDataFrame([], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
        return load(spark, folder)
    valid = valid.where(F.size("vector") == dimension)
    place = F.shiftrightunsigned(F.xxhash64("chunk_id", F.lit(5)), 1)
    share = min(1.0, 1.2 * sample / total + 1e-6)
    picked = valid.where(place < F.lit(min(int(share * 2**63), 2**63 - 1))).orderBy(place).limit(sample).select("vector").collect()  # at most ``sample`` vectors
    points = np.array([r["vector"] for r in picked], np.float64) if picked else np.zeros((1, dimension))
    found = centres(points, n_cells or int(min(MOST_CELLS, max(1, round(total**0.5)))))
    schema = StructType([*valid.schema.fields, StructField("cell", IntegerType()), StructField("distance", DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dimension)
            cell = nearest_centre(x, found)
            distance = np.sqrt(((x - found[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], names=[*batch.schema.names, "cell", "distance"])

    rows = valid.mapInArrow(assign, schema).repartitionByRange("cell", F.xxhash64("chunk_id")).sortWithinPartitions("cell", F.col("distance").desc())
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> CellIndex:
    """An index that was built before."""
    rows = spark.read.parquet(f"{folder}/rows")
    known = {r["cell"]: (r["n"], r["radius"]) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}
    found = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    centre = np.array([r["centre"] for r in found], np.float64) if found else np.zeros((0, 0))
    size, radius = (np.array([known.get(i, (0, 0.0))[j] for i in range(len(found))], t) for j, t in ((0, np.int64), (1, np.float64)))
    return CellIndex(rows, folder, centre, size, radius)


def _scan(ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, least: np.ndarray, centre: np.ndarray, k: int, digits: int):
    """The k best of a task's rows for each query (rows of ``wanted``: its cells), and how many rows were scored for it."""
    norms = np.sqrt((queries**2).sum(1))
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64()), ("scored", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scored = least.copy(), np.zeros(len(ids), np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else []
            for start, end in zip(edges, [*edges[1:], len(cells)], strict=True):
                asking = np.flatnonzero(wanted[:, cells[start]])
                if not len(asking):
                    continue
                part = batch.slice(int(start), int(end - start))
                reach = np.asarray(part.column("distance"))
                lead = queries[asking] @ centre[cells[start]]
                upto = len(reach) - np.searchsorted(reach[::-1], (own[asking] - _SLACK - lead) / np.maximum(norms[asking], 1e-300) * (1 - 1e-12) - 1e-12)  # rows fall with the distance
                upto[norms[asking] == 0] = len(reach)
                far = int(upto.max(initial=0))
                if not far:
                    continue
                x, chunk = _matrix(part.column("vector").slice(0, far), centre.shape[1]), np.asarray(part.column("chunk_id"))
                for i, n in zip(asking.tolist(), upto.tolist(), strict=True):
                    if n:
                        score = np.round(x[:n] @ queries[i], digits)
                        scored[i] += n
                        chunks, scores = chunk[:n], score
                        if i in best:
                            chunks, scores = np.concatenate((best[i][0], chunks)), np.concatenate((best[i][1], scores))
                        order = np.lexsort((chunks, -scores))[:k]
                        best[i] = chunks[order], scores[order]
                        if len(order) == k:
                            own[i] = max(own[i], scores[order[-1]])
        for i, (chunks, scores) in best.items():
            n = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * n, pa.int64()), pa.array(chunks, pa.int64()), pa.array(scores), pa.array([scored[i]] + [0] * (n - 1), pa.int64())], schema=schema)

    return search


def _search_block(ids: np.ndarray, queries: np.ndarray, index: CellIndex, rows: DataFrame, k: int, digits: int) -> tuple[DataFrame, dict]:
    lead, reach = queries @ index.centre.T, np.sqrt((queries**2).sum(1))[:, None] * index.radius
    # first the nearest centres that hold k vectors or more together, so that each query has a k-th best score
    order = np.argsort(-lead, axis=1)
    before = np.cumsum(index.size[order], axis=1) - index.size[order]
    wanted = np.zeros(lead.shape, bool)
    np.put_along_axis(wanted, order, before < k, axis=1)
    least, hits, read = np.full(len(ids), -np.inf), None, np.zeros(lead.shape, bool)
    for last in (False, True):
        cells = np.flatnonzero((wanted & (index.size > 0)).any(0)).tolist()
        part = rows.where(F.col("cell").isin(cells)) if len(cells) < len(index.size) else rows
        found = part.select("cell", "chunk_id", "vector", "distance").mapInArrow(_scan(ids, queries, wanted, least, index.centre, k, digits), "query_id long, chunk_id long, score double, scored long")
        found = settle(found, "hits")
        hits = found if hits is None else hits.unionByName(found)
        read |= wanted
        if not last:
            kth = top_k(hits, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()  # one row a query of the block
            at = {q: i for i, q in enumerate(ids.tolist())}
            for r in kth:
                least[at[r["query_id"]]] = r["least"]
            wanted = ~read & (lead + reach * (1 + 1e-9) >= least[:, None] - _SLACK)
            if not (wanted & (index.size > 0)).any():
                break
    scored = hits.agg(F.sum("scored")).first()[0] or 0
    pairs = read & (index.size > 0)
    return settle(top_k(hits, k).select("query_id", "chunk_id", "score", "rank"), "best"), {"queries": len(ids), "cells": int((index.size > 0).sum()), "pairs": int(pairs.sum()), "rows": int(index.size.sum()), "scored": int(scored)}


def search(queries: DataFrame, index: CellIndex, k: int, digits: int = 6, block_bytes: int = QUERY_BLOCK_BYTES, where=None) -> tuple[DataFrame, dict]:
    """The k best (query_id, chunk_id, score, rank) of each query (query_id, vector), and what was read: ``cells_read``, the share of pairs of query and cell, and ``rows_scored``, that of pairs of query and vector.

    ``where`` filters the index's rows by their payload."""
    spark = index.rows.sparkSession
    rows = index.rows if where is None else index.rows.where(where)
    queries = queries.where(F.size("vector") == index.dimension) if index.size.sum() else queries.where("false")
    n_blocks = (queries.agg(F.sum(F.size("vector") * 8)).first()[0] or 0) // block_bytes + 1
    out, total = spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int"), {}
    for block in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else queries
        asked = own.select(F.col("query_id").cast("long"), "vector").collect()  # about block_bytes
        if asked:
            hits, read = _search_block(np.array([r["query_id"] for r in asked], np.int64), np.array([r["vector"] for r in asked], np.float64), index, rows, k, digits)
            out = hits if not total else out.unionByName(hits)
            total = {key: total.get(key, 0) + n if key in ("queries", "pairs", "scored") else n for key, n in read.items()}
    shares = {"cells_read": total["pairs"] / (total["queries"] * total["cells"]), "rows_scored": total["scored"] / (total["queries"] * total["rows"])} if total else {"cells_read": 0.0, "rows_scored": 0.0}
    return out, total | shares
