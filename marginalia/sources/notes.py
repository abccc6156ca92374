"""Folders of Markdown notes, inventories, and artifacts."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text as T


def check_directory(name: str) -> str:
    """One direct child of the vault: not absolute, not ``.`` or ``..``, without separators."""
    if not name or name in (".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"{name!r} is not the name of a directory of the vault")
    return name


def check_folder(spark: SparkSession, folder: str) -> str:
    """A folder that is there, on whatever file system; ValueError before a job starts on one that is not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not files.getFileStatus(path).isDirectory():
        raise ValueError(f"{folder} is not a folder")
    return folder


def notes(spark: SparkSession, root: str, directories: list[str]) -> DataFrame:
    """path, relative_path, note, bytes, modified of all ``.md`` files below the allowed directories, lines ending in one way."""
    check_folder(spark, root)
    paths = [check_folder(spark, f"{root.rstrip('/')}/{check_directory(d)}") for d in directories]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(paths)
    relative = F.regexp_extract("path", f"{root.rstrip('/').split('/')[-1]}/(.*)$", 1)
    return files.select("path", relative.alias("relative_path"), T.unix_lines(F.decode("content", "UTF-8")).alias("note"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_inventory(stats: DataFrame, path: str) -> None:
    """One JSON object a line, fields in alphabetical order."""
    stats.select(*sorted(stats.columns)).write.mode("overwrite").json(path)


def read_inventory(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_artifacts(df: DataFrame, folder: str) -> None:
    """A result as JSON and as CSV (nested columns as JSON text)."""
    df.write.mode("overwrite").json(f"{folder}/json")
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def log_run(df: DataFrame, run_id: str, kind: str, path: str) -> None:
    """Append the numbers of a one-row summary as (run_id, kind, metric, value) rows; null metrics are left out."""
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("m"))
    rows.where("m.value IS NOT NULL").select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "m.metric", "m.value").write.mode("append").parquet(path)


def log_settings(spark: SparkSession, run_id: str, kind: str, path: str, params: dict, tags: dict | None = None) -> None:
    """Append what a run was made with as (run_id, kind, role, name, value) rows, roles being param and tag; values as JSON text."""
    rows = [(run_id, kind, role, name, json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)) for role, own in (("param", params), ("tag", tags or {})) for name, value in sorted(own.items())]
    spark.createDataFrame(rows, "run_id string, kind string, role string, name string, value string").write.mode("append").parquet(path)


def write_matrix(result: DataFrame, policies: dict, folder: str) -> None:
    """The results of an experiment (a row for each ``policy``) with a copy of what each policy was, and a manifest: policies in their order, their settings, and the columns that are measured."""
    spark = result.sparkSession
    write_artifacts(result, folder)
    copies = [(name, json.dumps(dataclasses.asdict(own), sort_keys=True)) for name, own in policies.items()]
    spark.createDataFrame(copies, "policy string, value string").coalesce(1).write.mode("overwrite").partitionBy("policy").text(f"{folder}/config")
    manifest = {"policies": [{"name": name, "config": f"config/policy={name}", **json.loads(value)} for name, value in copies], "metrics": [c for c in result.columns if c != "policy"]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
