"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Each stage groups by the
digest together with the whole normalised text, so texts are compared in full and a digest collision cannot merge two of them:

1. each task combines the copies it has read (the partial step of the first aggregation);
2. digest groups are merged within a salt, which stands for a share of the tasks; a text that fills a third of all rows thus
   meets in ``salts`` places, with one row for each task;
3. the salt winners, at most ``salts`` rows for a text, are combined globally.

Cases: a null text counts as empty, and empty texts equal each other. A null id loses against any other of equal length.
Rows that repeat an id with the same text are one document given twice: ``annotate`` gives both the same decision, and
``keep`` returns one of them. ``keep`` decides by rows, so two texts of one id, or of no id, both stay. An empty table gives an empty table.
Other columns are never read by ``annotate``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from marginalia.llm.util import numbered, numbered_texts, settle, spread_join, texts

BLANKS = "[\\x20\\x09-\\x0D]+"
SALTS = 32
KEYS = ["text_sha256", "check", "n_bytes"]


def _prepared(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c != "text"]
    return rows.select(*columns, F.length("text").cast("long").alias("n_chars"), F.regexp_replace("text", BLANKS, "").alias("body")).withColumn("text_sha256", F.sha2("body", 256))


def _digests(rows: DataFrame) -> DataFrame:
    return _prepared(rows).withColumns({"check": F.xxhash64("body"), "n_bytes": F.octet_length("body")}).drop("body")


def _classes(rows: DataFrame, salts: int) -> DataFrame:
    longest_first = F.col("n_chars").cast("decimal(38,0)") * F.lit(Decimal(2**64)) - F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(38,0)")
    rows = _prepared(rows).withColumn("rank", longest_first.cast("decimal(38,0)")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = rows.groupBy("text_sha256", "salt", "body").agg(F.max_by("doc_id", "rank").alias("keep_id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    whole = merged.groupBy("text_sha256", "body").agg(F.max_by("keep_id", "rank").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("text_sha256", F.xxhash64("body").alias("check"), F.octet_length("body").alias("n_bytes"), "keep_id", "group_size")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each different text: its digests, keep_id and group_size."""
    return _classes(texts(docs, id_col, text_col), salts)


def _joined(rows: DataFrame, whole: DataFrame, by: str) -> DataFrame:
    key = F.struct(*KEYS)
    return spread_join(settle(rows, "digests").withColumn("key", key), whole.select(key.alias("key"), "keep_id", "group_size"), "key", by)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet their class by three digests (SHA-256, xxhash64, length); a text of very many rows meets it in many places.
    """
    rows = texts(docs, id_col, text_col)
    return _joined(_digests(rows), _classes(rows, salts), "doc_id").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    packed = numbered(docs)
    rows = numbered_texts(packed, id_col, text_col)
    equal = _joined(_digests(rows), _classes(rows.drop("row"), salts), "row").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = equal.groupBy(*KEYS).agg(F.min(F.struct((-F.col("n_chars")).alias("shorter"), "row")).alias("first"))
    return packed.join(first.select("first.row"), "row", "left_semi").select("doc.*")
