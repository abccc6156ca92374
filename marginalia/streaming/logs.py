"""Query logs in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windows(logs: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """start, event_type, requests, mean latency per tumbling window. ``logs``: ts, event_type, value; batch or stream. With ``late``, rows that come
    later than that after the newest are dropped by the watermark and a stream's state stays bounded."""
    rows = logs.withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("value"), 6).alias("mean_latency"))
    return out.select(F.col("window.start").alias("start"), "event_type", "requests", "mean_latency")


def append(logs: DataFrame, accepted: str, rejected: str) -> tuple[DataFrame, DataFrame]:
    """Split log rows by the log's rules: latency floored at 0, method known, top_k positive."""
    ok = F.col("method").isin("dense", "bm25", "hybrid") & (F.col("top_k") > 0)
    rows = logs.withColumn("latency_ms", F.greatest("latency_ms", F.lit(0)))
    good, bad = rows.where(F.coalesce(ok, F.lit(False))), rows.where(~F.coalesce(ok, F.lit(False)))
    good.write.mode("append").parquet(accepted)
    bad.write.mode("append").parquet(rejected)
    return good, bad
