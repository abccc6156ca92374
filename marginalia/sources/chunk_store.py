"""Chunks and notes as bucketed tables: a generation is a partition, and a scan meets its notes without a shuffle.

Both tables are dealt to the same number of buckets by note and sorted by note (and chunk) inside, so that joining them moves nothing. A generation (chunking version) is replaced by overwriting its partition
alone; files of other generations are not touched. Tables are external, in a folder that driver and executors share.

Cases: an empty generation leaves the others as they are. A generation replaced by nothing keeps its old rows (use ``delete``). Chunks of unknown notes are stored and left out of ``scan``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.sources.storage import settle

VERSION = "chunking_version"


class ChunkStore:
    """Tables ``<name>_chunks`` and ``<name>_notes`` in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, name: str, buckets: int = 16):
        if not re.fullmatch(r"[A-Za-z]\w*", name) or buckets < 1:
            raise ValueError("a store has a plain name and buckets")
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.chunks, self.notes = f"{name}_chunks", f"{name}_notes"

    def _create(self, rows: DataFrame, table: str, sort: tuple[str, ...], partition: str | None) -> None:
        writer = rows.write.format("parquet").bucketBy(self.buckets, "note_id").sortBy(*sort).option("path", f"{self.folder}/{table}")
        (writer.partitionBy(partition) if partition else writer).mode("overwrite").saveAsTable(table)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """One task a bucket, so that a bucket is one file and its order holds."""
        return rows.repartition(self.buckets, "note_id")

    def put_notes(self, notes: DataFrame) -> None:
        """Replace the notes (note_id, ...)."""
        self._create(self._dealt(notes), self.notes, ("note_id",), None)

    def put(self, rows: DataFrame) -> None:
        """Replace the generations that ``rows`` (note_id, chunk_index, chunking_version, ...) hold; others stay as they are."""
        ordered = rows.select(*[c for c in rows.columns if c != VERSION], VERSION)
        if not self.spark.catalog.tableExists(self.chunks):
            return self._create(self._dealt(ordered), self.chunks, ("note_id", "chunk_index"), VERSION)
        columns = self.spark.table(self.chunks).columns
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "dynamic")
        try:
            self._dealt(ordered.select(*columns)).write.insertInto(self.chunks, overwrite=True)
        finally:
            self.spark.conf.set(setting, before)
        self.spark.catalog.refreshTable(self.chunks)

    def upsert(self, rows: DataFrame) -> None:
        """Replace whole notes within their generations."""
        versions = [r[VERSION] for r in rows.select(VERSION).distinct().collect()]  # a few names
        held = self.spark.table(self.chunks).where(F.col(VERSION).isin(versions))
        kept = held.join(rows.select("note_id", VERSION).distinct(), ["note_id", VERSION], "left_anti")
        self.put(settle(kept.select(*held.columns).unionByName(rows.select(*held.columns)), "generation"))

    def delete(self, version: str) -> None:
        """Drop a generation and its files."""
        quoted = version.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"ALTER TABLE {self.chunks} DROP IF EXISTS PARTITION ({VERSION} = '{quoted}')")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.chunks}/{VERSION}={version}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark.catalog.refreshTable(self.chunks)

    def scan(self, version: str) -> DataFrame:
        """The chunks of a generation with their notes, bucket by bucket in the order of notes and chunks."""
        own = self.spark.table(self.chunks).where(F.col(VERSION) == version)
        return own.join(self.spark.table(self.notes).hint("merge"), "note_id").sortWithinPartitions("note_id", "chunk_index")
