"""A vault's folder as a stream into ingestion runs.

New files arrive as a batch; each batch is one run over them, joined to the notes that are stored. A batch writes what it leaves behind under its own version, from the notes of the version before it, so a batch that is
tried again changes nothing. A stream sees a path once: ``rescan`` runs over the whole vault for files that were changed in place and for notes that are gone. Batches have the even versions, a rescan has the odd
one after the last batch, so it can be repeated too.

Cases: a file that is not UTF-8 is a ``read_error``: it is stored as failed, with the error in its state, and the run goes on. Files that are links, hidden, or without ``.md`` are left out. Nothing new makes no run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions import identity as I, text as T
from marginalia.operators import ingest as G, markdown as M
from marginalia.sources import notes as N
from marginalia.streaming.ingest import drain

NOTES = "note_id long, relative_path string, source_directory string, title string, content_hash string, parse_status string, parser_version string"


def files(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """The vault's Markdown files as a stream: relative_path, content. ``most_files`` in a batch."""
    N.check_folder(spark, root)
    name = root.rstrip("/").split("/")[-1]
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).option("maxFilesPerTrigger", most_files).load(root)
    return raw.select(F.regexp_extract("path", f"(?:^|/){name}/(.*)$", 1).alias("relative_path"), "content")


def found(batch: DataFrame, parser_version: str) -> DataFrame:
    """What a run takes of files: their notes, or why they could not be read."""
    readable: Column = F.is_valid_utf8(F.col("content"))
    note = F.when(readable, T.unix_lines(F.col("content").cast("string")))
    return batch.select(
        "relative_path", F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("source_directory"), I.note_title(F.col("relative_path")).alias("title"), F.sha2(F.coalesce(note, F.hex("content")), 256).alias("content_hash"),
        F.when(readable, "parsed").otherwise("failed").alias("parse_status"), F.lit(parser_version).alias("parser_version"), F.when(~readable, "read_error").alias("error_type"), F.when(~readable, "not UTF-8").alias("error_message"), note.alias("note"),
    )


def _last(spark: SparkSession, work: str, before: int) -> DataFrame:
    """The notes and their last states as the latest version before this one left them."""
    rows = spark.read.schema(NOTES + ", last_status string, version int").parquet(f"{work}/notes")
    top = rows.where(F.col("version") < before).agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == (-1 if top is None else top)).drop("version")


def _write(rows: DataFrame, work: str, version: int, corpus_scope: str, parser_version: str, scope: list[str] | None) -> None:
    """One run over files (relative_path, content), written under its version."""
    seen = G.settle(found(rows, parser_version), "found")
    stored = G.settle(_last(rows.sparkSession, work, version), "stored")
    links = M.links(M.lines(seen.where("note IS NOT NULL").select(F.col("relative_path").alias("note_id"), "note"))).withColumnRenamed("note_id", "relative_path")
    made = G.run(seen.drop("note"), stored, links, version, corpus_scope, scope)
    states = made["states"].select("relative_path", F.col("status").alias("new_status"))
    kept = made["notes"].join(stored.select("relative_path", "last_status"), "relative_path", "left").join(states, "relative_path", "left")
    columns = [f.split()[0] for f in NOTES.split(", ")]
    out = {"notes": kept.select(*columns, F.coalesce("new_status", "last_status").alias("last_status")), **{k: made[k] for k in ("states", "links", "run")}}
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{work}/{name}/version={version}")


def _begin(spark: SparkSession, work: str) -> None:
    spark.createDataFrame([], NOTES + ", last_status string").write.mode("overwrite").parquet(f"{work}/notes/version=-1")


def ingest_folder(spark: SparkSession, root: str, work: str, corpus_scope: str, parser_version: str = "p1", most_files: int = 1000) -> None:
    """Ingest what has arrived in the vault and stop. In ``work``: notes, states, links and runs by version, and the stream's checkpoint."""
    _begin(spark, work)
    drain(files(spark, root, most_files), work, lambda batch, batch_id: _write(batch, work, 2 * batch_id, corpus_scope, parser_version, []))


def rescan(spark: SparkSession, root: str, work: str, corpus_scope: str, parser_version: str = "p1") -> int:
    """A run over the whole vault, stale notes included; its version."""
    _begin(spark, work)
    stored = spark.read.schema("version int").parquet(f"{work}/notes").where("version % 2 = 0").agg(F.max("version")).first()[0]
    version = (-2 if stored is None else stored) + 1
    name = N.check_folder(spark, root).rstrip("/").split("/")[-1]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    _write(raw.select(F.regexp_extract("path", f"(?:^|/){name}/(.*)$", 1).alias("relative_path"), "content"), work, max(version, 1), corpus_scope, parser_version, None)
    return max(version, 1)


def current(spark: SparkSession, work: str) -> DataFrame:
    """The notes after the last version."""
    return _last(spark, work, 1 << 30)
