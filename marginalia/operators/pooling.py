"""Pooling of token vectors to one vector a chunk: the last step of an encoder.

Token vectors of a batch are one flat array with offsets (ragged lists), so that truncation, masking, the weighted mean and the normalisation are numpy operations over all tokens of the batch.

Cases: null or empty tokens, and a mask without weight, give no vector (status ``empty``); a token of another length, a null or not finite number in what is pooled, or a mask of another length than the tokens gives none either
(``invalid``). A null mask counts every token once. A mean of length zero stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "chunk_id long, vector array<double>, n_tokens int, status string"


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists (0 for null) and their values one after the other."""
    lengths = np.diff(np.asarray(column.offsets))
    lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    return lengths, column.flatten()


def pooled(tokens: pa.ListArray, mask: pa.ListArray, dimension: int, most: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Vectors (zero where there is none), numbers of tokens pooled, and statuses of the rows of a batch."""
    n = len(tokens)
    lengths, vectors = _ragged(tokens)
    mask_lengths, weights = _ragged(mask)
    no_mask = np.asarray(mask.is_null())
    row = np.repeat(np.arange(n), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bad = ~no_mask & (mask_lengths != lengths)
    weight = np.ones(len(row))
    own = ~(no_mask | bad)
    given = np.asarray(weights.fill_null(0), np.float64)
    weight[own[row]] = given[np.repeat(own, mask_lengths)]
    used = (place < most) & (weight != 0)
    sizes, values = _ragged(vectors)
    right = sizes == dimension
    np.logical_or.at(bad, row[used & ~right], True)
    used &= right & ~bad[row]
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    starts = np.cumsum(sizes) - sizes
    x = flat[starts[used][:, None] + np.arange(dimension)] if used.any() else np.zeros((0, dimension))
    broken = ~np.isfinite(x).all(1)
    np.logical_or.at(bad, row[used][broken], True)
    sums, total = np.zeros((n, dimension)), np.bincount(row[used], weight[used], minlength=n)
    rows_used = row[used]
    if len(rows_used):
        first = np.flatnonzero(np.concatenate(([True], rows_used[1:] != rows_used[:-1])))
        sums[rows_used[first]] = np.add.reduceat(x * weight[used][:, None], first, axis=0)
    there = (total != 0) & ~bad
    mean = np.where(there[:, None], sums / np.where(total == 0, 1, total)[:, None], 0.0)
    norm = np.sqrt((mean**2).sum(1))
    mean = mean / np.where(norm == 0, 1, norm)[:, None]
    status = np.where(bad, "invalid", np.where(there, "ok", "empty")).tolist()
    return mean, np.where(there, np.bincount(rows_used, minlength=n), 0), status


def pool(chunks: DataFrame, dimension: int, most: int = 512) -> DataFrame:
    """SCHEMA of chunks (chunk_id, tokens: arrays of numbers, mask: weights of tokens): the mean of the first ``most`` tokens by their weights, of length one."""
    rows = chunks.select(F.col("chunk_id").cast("long"), F.col("tokens").cast("array<array<double>>"), F.col("mask").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, n, status = pooled(batch.column(1), batch.column(2), dimension, most)
            good = np.array([s == "ok" for s in status], bool)
            offsets = pa.array(np.concatenate(([0], np.cumsum(good * dimension))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors[good].ravel()), mask=pa.array(~good)) if len(batch) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n, pa.int32()), pa.array(status, pa.string())], names=["chunk_id", "vector", "n_tokens", "status"])

    return rows.mapInArrow(run, SCHEMA)
