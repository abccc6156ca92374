"""Incremental ingestion: what has arrived since the last run, as one or more micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def drain(stream: DataFrame, work: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run all available input through ``each`` and stop. The checkpoint in ``work`` makes a rerun go on where the last one ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; rows that are equal in the order are told apart by all their columns, so a rerun keeps the same one."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, *others)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def ingest(stream: DataFrame, work: str, keys: list[str], *order: str) -> DataFrame:
    """Add what has arrived to the table in ``work`` and return the table: the last row of each key, by batch and, within one, by ``order``.

    A batch appends its own rows only, under its batch id, so a batch that is retried overwrites its own output and the table is never rewritten; ``compact``
    makes one batch of many. A run that finds nothing new returns the table as it is."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _last(batch, keys, *order).write.mode("overwrite").parquet(f"{work}/deltas/batch={batch_id}")

    drain(stream, work, each)
    return current(stream.sparkSession, work, keys, stream.schema)


def current(spark: SparkSession, work: str, keys: list[str], schema: StructType) -> DataFrame:
    """The table of ``ingest``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/deltas")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{work}/deltas")
    return _last(rows, keys, "batch").select(*schema.names)


def compact(spark: SparkSession, work: str, keys: list[str], schema: StructType, folder: str) -> None:
    """Write the table, one row a key, in another folder."""
    current(spark, work, keys, schema).write.parquet(folder)
