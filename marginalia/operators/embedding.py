"""Batch embedding, vector checks, and the comparison of a chunk store with a vector store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

NORM_TOLERANCE = 1e-4


def _norm():
    return F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def validity(vectors: DataFrame, dimension: int, tolerance: float = NORM_TOLERANCE) -> DataFrame:
    """chunk_id, dimension, norm, valid: of the right dimension, finite and of unit norm."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("chunk_id", F.size("vector").cast("long").alias("dimension"), F.round(_norm(), 6).alias("norm"), ((F.size("vector") == dimension) & finite & (F.abs(_norm() - 1) <= tolerance)).alias("valid"))


def norms(vectors: DataFrame, *by: str) -> DataFrame:
    rows = vectors.withColumn("norm", _norm())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg("norm"), 6).alias("mean_norm"), F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"), F.sum(F.size("vector") * 4).alias("vector_bytes"))


def consistency(stored: DataFrame, points: DataFrame, fields: list[str], key: str = "chunk_id") -> DataFrame:
    """key and difference (missing, extra, or the names of unequal fields) of rows that differ."""
    a = stored.select(key, F.struct(*fields).alias("a"))
    b = points.select(key, F.struct(*fields).alias("b"))
    unequal = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])), ",")
    difference = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise(unequal)
    return a.join(b, key, "full_outer").select(key, difference.alias("difference")).where("difference <> ''")


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = 32, retries: int = 2, prefix: str = "passage: ") -> DataFrame:
    """chunk_id, vector, status (ok or failed), attempts, error, batch, seconds. A batch is tried 1 + retries times and fails as a whole; ``batch`` tells batches apart, and the first row of one has its seconds.

    ``model`` maps texts to vectors; it runs in the tasks, once for each batch of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part, vectors, error, attempt, began = frame.iloc[lo : lo + batch], None, None, 0, time.monotonic()
                while vectors is None and attempt <= retries:
                    attempt += 1
                    try:
                        got = model([prefix + t for t in part["text"]])
                        bad = len(got) != len(part) or any(len(v) != dimension or any(x != x or abs(x) == float("inf") for x in v) for v in got)
                        vectors, error = (None, "invalid vectors") if bad else (got, None)
                    except Exception as e:  # a failing model is a status, not a failed job
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "vector": vectors or [None] * len(part), "status": "failed" if vectors is None else "ok", "attempts": attempt, "error": error, "batch": uuid.uuid4().hex, "seconds": [time.monotonic() - began] + [0.0] * (len(part) - 1)})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, vector array<double>, status string, attempts int, error string, batch string, seconds double")


def hashing_model(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an encoder: signed word hashes, normalised."""

    def model(texts: list[str]) -> list[list[float]]:
        import math
        import re
        import zlib

        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return model


def batch_result(embedded: DataFrame) -> DataFrame:
    """Totals of an embedding run: chunks, batches, attempts (of batches), failures, seconds spent in batches, and vectors a second of them."""
    batches = embedded.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status"), F.max("attempts").alias("attempts"), F.sum("seconds").alias("seconds"))
    good = F.col("status") == "ok"
    n = batches.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("embedded"), F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("attempts") > 1, F.col("n"))), F.lit(0)).alias("retried"), F.count(F.lit(1)).alias("batches"), F.count_if(good).alias("batches_succeeded"), F.count_if(~good).alias("batches_failed"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )
    rate = F.when(F.col("seconds") > 0, F.col("embedded") / F.col("seconds")).otherwise(0.0)
    return n.withColumns({"vectors_per_second": rate, "failure_rate": F.when(F.col("chunks") > 0, F.col("failed") / F.col("chunks")).otherwise(0.0)})
