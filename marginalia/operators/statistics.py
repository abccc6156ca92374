"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import text as T
from marginalia.sources.storage import settle


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, words by language, content hash, anomaly."""
    body = T.unix_lines(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), "source", body.alias("body"), T.analysis_text(body).alias("plain")).withColumn("line", T.word_line(F.col("plain")))
    anomaly = F.when(F.trim("body") == "", "empty_document").when(F.trim("plain") == "", "no_text_after_structure")
    return rows.select("doc_id", "source", F.octet_length("body").cast("long").alias("file_size_bytes"), F.length("body").cast("long").alias("character_count"), *T.language_counts(F.col("line")), T.content_hash(F.col("body")).alias("content_hash"), anomaly.alias("anomaly"))


def distribution(value: Column) -> list[Column]:
    """count, min, max, mean, median, std and percentiles (linear) of a column of counts, rounded to 6 digits.

    A percentile holds a count for each different value; sizes and numbers of words have few. For measured values see ``quantiles``."""
    v = value.cast("double")
    named = {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": F.percentile(v, 0.5), "std": F.coalesce(F.stddev_samp(v), F.lit(0.0)), "p25": F.percentile(v, 0.25), "p75": F.percentile(v, 0.75), "p90": F.percentile(v, 0.9), "p95": F.percentile(v, 0.95)}
    return [F.count(v).alias("count")] + [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(k) for k, c in named.items()]


def duplicate_groups(stats: DataFrame) -> DataFrame:
    """Hashes that several documents share: how many, and the first and last of them."""
    return stats.groupBy("content_hash").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("documents > 1")


def duplicate_members(stats: DataFrame) -> DataFrame:
    """content_hash, documents, doc_id: every document of a group of equal ones; a group of any size is rows, not a list."""
    groups = stats.groupBy("content_hash").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    return stats.select("content_hash", "doc_id").join(groups, "content_hash").select("content_hash", "documents", "doc_id")


def summary(stats: DataFrame) -> DataFrame:
    """One row over the inventory."""
    copies = duplicate_groups(stats).agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("documents"), F.lit(0)).alias("duplicate_documents"))
    ok = stats.agg(
        F.count(F.lit(1)).alias("total_documents"), F.sum("file_size_bytes").alias("total_bytes"), F.sum("word_count").alias("total_words"),
        F.round(F.avg("file_size_bytes"), 6).alias("mean_bytes"), F.round(F.percentile("file_size_bytes", 0.5), 6).alias("median_bytes"), F.round(F.avg(F.col("anomaly").isNotNull().cast("int")), 6).alias("anomaly_rate"),
    )
    return ok.crossJoin(copies)  # one row each


def quantiles(rows: DataFrame, value: Column, named: dict[str, float], *by: str) -> DataFrame:
    """Exact linear percentiles of any values by group, null where a group has none: the columns of ``by``, and ``named``.

    Values are counted, dealt to tasks by ranges of group and value, and each range gets its offset from the ranges before it, so no task or
    buffer holds a group."""
    counts = rows.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = settle(counts.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()), "values")
    parts = ranged.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))
    w = W.partitionBy(*by)
    parts = parts.withColumn("before", F.sum("in_part").over(w.orderBy("part")) - F.col("in_part")).withColumn("all", F.sum("in_part").over(w))
    placed = ranged.withColumn("inner", F.sum("n").over(W.partitionBy(*by, "part").orderBy("v"))).alias("x")
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in by], F.col("part").alias("p_part"), "before", "all")
    same = F.col("part") == F.col("p_part")
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"p_{c}"))
    upto = placed.join(parts, same).withColumn("upto", F.col("before") + F.col("inner"))

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("v")))

    found = []
    for name, q in named.items():
        place = (F.col("all") - 1) * F.lit(float(q))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        found.append(F.round(low + share * (high - low), 6).alias(name))
    keys = [F.col(f"x.{c}").alias(c) for c in by]
    return upto.groupBy(*keys).agg(*found) if by else upto.agg(*found)
