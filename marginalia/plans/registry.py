"""All queries of the package, by name, with SQL for the same result."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
SQL: dict = {}

#: A Markdown note made of a document's columns: two headings, one link, then the text
NOTE = "concat('# ', source, chr(10), chr(10), split_part(text, chr(10), 1), chr(10), chr(10), '## ', lang, chr(10), chr(10), '- [[', source, '/', cast(doc_id + 1 as {string}), '|next]]', chr(10), text)"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, whole numbers as long."""

    def register(f):
        @wraps(f)
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id and note (Markdown), with source."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS note_id", "source", NOTE.format(string="string") + " AS note")


NOTES_SQL = f"notes AS (SELECT doc_id AS note_id, source, {NOTE.format(string='varchar')} AS note FROM documents)"

for _name in ("corpus", "markdown", "retrieval", "metrics", "ingest", "serving", "experiments", "streams", "stores"):
    import_module(f"marginalia.plans.{_name}")
