"""Idempotent ingestion: what changed, what is stale, states and audits, link resolution, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from marginalia.functions import identity as I
from marginalia.sources.storage import settle

KEY = "relative_path"


def incoming(stats: DataFrame, path: str = KEY) -> DataFrame:
    """Note rows of parsed files: the first part of the path is the directory, the stem the title."""
    ok = F.when(F.col("status") == "ok", "parsed").otherwise("failed")
    return stats.select(F.col(path).alias(KEY), F.split_part(path, F.lit("/"), F.lit(1)).alias("source_directory"), I.note_title(F.col(path)).alias("title"), "content_hash", ok.alias("parse_status"), "parser_version")


def decide(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Classify each incoming note against its last state: failed, new, changed or unchanged, with the reason."""
    old = previous.select(KEY, F.col("content_hash").alias("old_hash"), F.col("parser_version").alias("old_version"), F.col("last_status").alias("old_status"))
    same = F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.col("parser_version").eqNullSafe(F.col("old_version"))
    reason = (
        F.when(F.col("parse_status") != "parsed", "incoming_note_failed_to_parse")
        .when(F.col("old_hash").isNull() & F.col("old_version").isNull(), "no_persisted_note_at_relative_path")
        .when(F.col("old_status") == "failed", "previous_attempt_failed_and_requires_retry")
        .when(same, "content_and_parser_version_match")
        .otherwise("content_or_parser_version_changed")
    )
    decision = F.when(F.col("reason").startswith("incoming"), "failed").when(F.col("reason").startswith("no_"), "new").when(F.col("reason").endswith("match"), "unchanged").otherwise("changed")
    return new.join(old, KEY, "left").withColumn("reason", reason).withColumn("decision", decision).withColumn("should_process", F.col("decision").isin("new", "changed")).drop("old_hash", "old_version", "old_status")


def stale(new: DataFrame, previous: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Stored notes, of the directories in scope, that were not found."""
    held = previous if scope is None else previous.where(F.split_part(KEY, F.lit("/"), F.lit(1)).isin(scope))
    return held.join(new.select(KEY), KEY, "left_anti")


def counters(decided: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: notes by decision, stale notes (outside the total), success rate, status."""
    kinds = ("new", "changed", "unchanged", "failed")
    n = decided.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decision") == k).alias(k) for k in kinds]).crossJoin(gone.agg(F.count(F.lit(1)).alias("stale")))
    status = F.when((F.col("total") > 0) & (F.col("failed") == F.col("total")), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    rate = F.when(F.col("total") == 0, 0.0).otherwise((F.col("new") + F.col("changed") + F.col("unchanged")) / F.col("total"))
    return n.select("*", F.round(rate, 6).alias("success_rate"), (F.col("new") + F.col("changed") + F.col("unchanged")).alias("succeeded"), F.col("unchanged").alias("skipped"), status.alias("status"))


def states(decided: DataFrame, gone: DataFrame, run_id: int) -> DataFrame:
    """The state rows that a run appends: one for each note, stale ones included."""
    rows = decided.select(KEY, F.col("decision").alias("status"), "reason").unionByName(gone.select(KEY, F.lit("stale").alias("status"), F.lit("not_discovered").alias("reason")))
    return rows.withColumn("run_id", F.lit(run_id))


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row per key by the given columns; only the last row of a task is shuffled."""
    columns = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(by, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those of the new keys, and the new rows."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_generation(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete whole groups (such as a note and version) that ``new`` brings, then insert."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Ids of wanted dimension rows, null-safe on the keys; new ones are numbered after the largest id."""
    match = None
    for k in keys:
        c = existing[k].eqNullSafe(wanted[k])
        match = c if match is None else match & c
    found = wanted.join(existing, match, "left").select(*[wanted[k] for k in keys], existing[id_col])
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    own = F.row_number().over(W.partitionBy(F.col(id_col).isNull()).orderBy(*keys))  # a dimension table: a few rows
    return found.crossJoin(top).withColumn(id_col, F.coalesce(F.col(id_col), F.col("top") + own)).drop("top")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedup_links(links: DataFrame) -> DataFrame:
    """One link for each note and target, with the first alias."""
    return links.groupBy("note_id", "target").agg(F.min_by(F.struct("line", "place", "alias"), F.struct("line", "place")).alias("r")).select("note_id", "target", "r.*")


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """target_note_id of each link: the only note of that path, else the only one of that title, else null. ``notes``: note_id, relative_path, title."""
    by_path = notes.groupBy(I.path_key(F.col(KEY)).alias("pk")).agg(F.count(F.lit(1)).alias("n_path"), F.max("note_id").alias("path_note"))
    by_title = notes.groupBy(I.casefold(F.col("title")).alias("tk")).agg(F.count(F.lit(1)).alias("n_title"), F.max("note_id").alias("title_note"))
    keyed = links.withColumn("base", I.link_base(F.col("target"))).withColumn("pk", I.casefold(F.col("base"))).withColumn("tk", I.casefold(F.element_at(F.split("base", "/"), -1)))
    joined = keyed.join(by_path, "pk", "left").join(by_title, "tk", "left")
    target = F.when(F.col("n_path") == 1, F.col("path_note")).when(F.col("n_title") == 1, F.col("title_note"))
    return joined.select(*links.columns, target.alias("target_note_id"))


def new_note_id(path: Column) -> Column:
    """The id of a note that is not stored yet: 62 bits of a hash of its path, so no task needs a counter and a rerun gives the same."""
    return F.shiftrightunsigned(F.xxhash64(path), 2)


def run(found: DataFrame, stored: DataFrame, links: DataFrame, run_id: int, corpus_scope: str, scope: list[str] | None = None) -> dict[str, DataFrame]:
    """One ingestion run over all discovered files; what it leaves behind: notes, states, links, run.

    ``found``: relative_path, source_directory, title, content_hash, parse_status (parsed or failed), parser_version, error_type, error_message. ``stored``: note_id, these columns without the
    errors, last_status. ``links``: relative_path, target, alias, line, place of parsed files.

    A file that cannot be read or parsed does not end the run: if its path is new it gets a note row with status failed, else the stored row stays; the state holds the error.
    Notes of the scope that were not found are stale and stay stored. Links of every parsed file are replaced and resolved against the notes after the run."""
    columns = [KEY, "source_directory", "title", "content_hash", "parse_status", "parser_version"]
    decided = decide(found, stored).join(stored.select(KEY, "note_id"), KEY, "left")
    decided = settle(decided.withColumn("known", F.col("note_id").isNotNull()).withColumn("note_id", F.coalesce("note_id", new_note_id(F.col(KEY)))), "decided")
    written = decided.where(F.col("should_process") | ~F.col("known")).select("note_id", *columns)
    notes = upsert(stored.select("note_id", *columns), written, [KEY])
    gone = stale(found, stored, scope)
    seen = decided.select("note_id", KEY, F.col("decision").alias("status"), "reason", "content_hash", "parser_version", "error_type", "error_message")
    missed = gone.select("note_id", KEY, F.lit("stale").alias("status"), F.lit("not_discovered").alias("reason"), "content_hash", "parser_version", F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"))
    own = dedup_links(links.join(decided.where("decision <> 'failed'").select(KEY, "note_id"), KEY).drop(KEY))
    return {
        "notes": notes, "states": seen.unionByName(missed).withColumn("run_id", F.lit(run_id)), "links": resolve_links(own, notes),
        "run": counters(decided, gone).select(F.lit(run_id).alias("run_id"), F.lit(corpus_scope).alias("corpus_scope"), "*"),
    }


RUN = "run_id long, corpus_scope string, total long, new long, changed long, unchanged long, failed long, stale long, success_rate double, succeeded long, skipped long, status string"


def store_states(states: DataFrame, folder: str, run_id: int, corpus_scope: str) -> DataFrame:
    """Write the states of a run in a folder of its own and return its row (RUN, as ``run`` has it): the write counts what it writes, so nothing is read a second time."""
    seen = Observation("states")
    kinds = ("new", "changed", "unchanged", "failed", "stale")
    counted = states.observe(seen, *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    counted.drop("run_id").write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")
    n = {k: seen.get[k] for k in kinds}
    good, total = n["new"] + n["changed"] + n["unchanged"], n["new"] + n["changed"] + n["unchanged"] + n["failed"]
    status = "completed" if not n["failed"] else "partial" if good else "failed"
    return states.sparkSession.createDataFrame([(run_id, corpus_scope, total, *(n[k] for k in kinds), round(good / total, 6) if total else 0.0, good, n["unchanged"], status)], RUN)
