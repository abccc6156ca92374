"""Evaluation files: gold questions, paraphrases, rankings, human scores. Small YAML files are read on the driver and checked there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.functions.policies import stripped


def _text(item: dict, field: str, where: str) -> str:
    value = item.get(field)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{where}: {field} is blank")
    return value.strip()


def check_gold(content: dict) -> list[tuple[str, str, str, str, str, list[str]]]:
    """Rows (item_id, question, dataset_version, corpus_scope, source_directory, paths) of a gold mapping; ValueError for blanks, repeated ids and items without notes."""
    if not isinstance(content, dict) or not isinstance(content.get("items"), list) or not content["items"]:
        raise ValueError("a gold file is a mapping with items")
    version, scope = _text(content, "dataset_version", "gold"), _text(content, "corpus_scope", "gold")
    rows: dict[str, tuple] = {}
    for n, item in enumerate(content["items"]):
        if not isinstance(item, dict):
            raise ValueError(f"item {n} is not a mapping")
        item_id, given = _text(item, "id", f"item {n}"), item.get("relevant_notes")
        if item_id in rows:
            raise ValueError(f"{item_id}: repeated")
        if not isinstance(given, list) or not given or not all(isinstance(p, str) and p.strip() for p in given):
            raise ValueError(f"{item_id}: relevant_notes are paths, one at least")
        rows[item_id] = (item_id, _text(item, "question", item_id), version, scope, _text(item, "source_directory", item_id), [p.strip().replace("\\", "/") for p in given])
    return list(rows.values())


def check_paraphrases(content: dict) -> list[tuple[str, str, str, list[str]]]:
    """Rows (dataset_version, group_id, canonical, paraphrases); ValueError for blanks, repeated ids and groups without paraphrases."""
    if not isinstance(content, dict) or not isinstance(content.get("groups"), list) or not content["groups"]:
        raise ValueError("a paraphrase file is a mapping with groups")
    version, rows = _text(content, "dataset_version", "paraphrases"), {}
    for n, group in enumerate(content["groups"]):
        if not isinstance(group, dict):
            raise ValueError(f"group {n} is not a mapping")
        group_id, others = _text(group, "id", f"group {n}"), group.get("paraphrases")
        if group_id in rows or not isinstance(others, list) or not others or not all(isinstance(p, str) and p.strip() for p in others):
            raise ValueError(f"{group_id}: repeated, or without paraphrases")
        rows[group_id] = (version, group_id, _text(group, "canonical", group_id), [p.strip() for p in others])
    return list(rows.values())


def gold(spark: SparkSession, content: dict) -> DataFrame:
    return spark.createDataFrame(check_gold(content), "item_id string, question string, dataset_version string, corpus_scope string, source_directory string, paths array<string>")


def paraphrases(spark: SparkSession, content: dict) -> DataFrame:
    return spark.createDataFrame(check_paraphrases(content), "dataset_version string, group_id string, canonical string, paraphrases array<string>")


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """query_id, key, rank of a rankings file: {"items": [{"id", "ranked_paths"}]}."""
    rows = spark.read.schema("items array<struct<id: string, ranked_paths: array<string>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("items").alias("i")).select(F.col("i.id").alias("query_id"), F.posexplode("i.ranked_paths").alias("at", "key")).select("query_id", "key", (F.col("at") + 1).alias("rank"))


def bind_gold(items: DataFrame, index: DataFrame) -> DataFrame:
    """item_id, path, note_id (null where the path is unknown), each path once. ``index``: path, note_id."""
    clean = stripped(F.replace("path", F.lit("\\"), F.lit("/")))
    return items.select("item_id", clean.alias("path")).distinct().join(index, "path", "left").select("item_id", "path", "note_id")


def evaluation_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """item_id and the id it is stored under: its own where it is known, else ``eval-<id>``. ``known``: item_id, stored_id."""
    return items.join(known, "item_id", "left").withColumn("stored_id", F.coalesce("stored_id", F.concat(F.lit("eval-"), "item_id")))


def replace_evaluation(items: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Store the gold items (rows of ``gold``) with their notes' ids as the one current set, a question of a dataset once (the last item wins), and return the table:
    eval_item_id, question, corpus_scope, dataset_version, relevant_note_ids. ``index``: path, note_id. ValueError for paths that no note has."""
    listed = items.select("item_id", "question", "corpus_scope", "dataset_version", F.posexplode("paths").alias("place", "path"))
    found = listed.join(index, "path", "left")
    if unknown := missing_paths(found):
        raise ValueError(f"no note at {', '.join(unknown)}")
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "note_id"))), lambda x: x["note_id"]))
    whole = found.groupBy("item_id", "question", "corpus_scope", "dataset_version").agg(ids.alias("relevant_note_ids"))
    last = whole.groupBy("dataset_version", "question").agg(F.max_by(F.struct("item_id", "corpus_scope", "relevant_note_ids"), "item_id").alias("last"))
    number = F.row_number().over(W.orderBy("dataset_version", "last.item_id")).cast("long")  # gold is a short, hand-written table
    last.select(number.alias("eval_item_id"), "question", "last.corpus_scope", "dataset_version", "last.relevant_note_ids").write.mode("overwrite").parquet(folder)
    return items.sparkSession.read.parquet(folder)


def load_evaluation(spark: SparkSession, folder: str, dataset_version: str) -> DataFrame:
    """The stored items of a dataset in the order of their ids; ValueError for a blank version and for ids of notes that are missing or not positive."""
    if not dataset_version.strip():
        raise ValueError("a dataset version is not blank")
    rows = spark.read.parquet(folder).where(F.col("dataset_version") == dataset_version)
    ids = F.col("relevant_note_ids")
    bad = rows.where(ids.isNull() | (F.size(ids) == 0) | F.exists(ids, lambda i: i.isNull() | (i <= 0))).select("eval_item_id").limit(20).collect()
    if bad:
        raise ValueError(f"items with bad note ids: {', '.join(str(r['eval_item_id']) for r in bad)}")
    return rows.orderBy("eval_item_id")


def missing_paths(bound: DataFrame, most: int = 20) -> list[str]:
    """The first paths, in order, of gold that no note has: an empty list before a run may start."""
    return [r["path"] for r in bound.where("note_id IS NULL").select("path").distinct().orderBy("path").limit(most).collect()]


def write_review(rows: DataFrame, path: str) -> None:
    """A review as JSON lines, fields in alphabetical order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def human_review(sample: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sampled ids with what a run gave them; ``missing`` where it has none."""
    return sample.join(artifacts.withColumn("found", F.lit(True)), "id", "left").withColumn("missing", F.col("found").isNull()).drop("found")


def prefix(gold_items: DataFrame, n: int) -> DataFrame:
    """The first n items in id order."""
    return gold_items.orderBy("item_id").limit(n)
