"""Run summaries: answer cache, token budgets, generation, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import policies as P
from marginalia.operators import metrics as X, serving as S, statistics as Q


def _r(c: Column) -> Column:
    return F.round(c, 6)


def _p(value: Column, q: float) -> Column:
    return _r(F.percentile(value, q))


def cache_summary(rows: DataFrame) -> DataFrame:
    """rows: group_id, pass (canonical or paraphrase), hit, latency_ms, prompt_tokens, generated_tokens. One row."""
    canonical, paraphrase = F.col("pass") == "canonical", F.col("pass") == "paraphrase"
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("generated_tokens", F.lit(0))
    latency = F.col("latency_ms")
    out = rows.agg(
        F.count_distinct("group_id").alias("group_count"), F.count_if(canonical).alias("canonical_count"), F.count_if(paraphrase).alias("paraphrase_count"), F.count_if(paraphrase & F.col("hit")).alias("paraphrase_hits"),
        F.sum(F.when(canonical, tokens).otherwise(0)).alias("pass1_tokens"), F.sum(F.when(paraphrase, tokens).otherwise(0)).alias("pass2_tokens"),
        _r(F.avg(F.when(paraphrase & F.col("hit"), latency))).alias("hit_avg_latency_ms"), _r(F.avg(F.when(paraphrase & ~F.col("hit"), latency))).alias("miss_avg_latency_ms"),
    )
    out = out.crossJoin(Q.quantiles(rows, latency, {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})).crossJoin(Q.quantiles(rows, F.when(canonical, latency), {"canonical_latency_p50_ms": 0.5}))  # one row each
    rate = F.when(F.col("paraphrase_count") == 0, 0.0).otherwise(F.col("paraphrase_hits") / F.col("paraphrase_count"))
    return out.withColumn("hit_rate", _r(rate)).withColumn("tokens_saved", F.greatest(F.col("pass1_tokens") - F.col("pass2_tokens"), F.lit(0)))


def budget_summary(rows: DataFrame) -> DataFrame:
    """rows: budget, skipped, refused, prompt_tokens, latency_ms, packed_chunks, ndcg. One row per budget: skipped rows leave all means,
    refused ones only the scores."""
    live, scored = ~F.col("skipped"), ~F.col("skipped") & ~F.col("refused")

    def of(name: str, which: Column = live) -> Column:
        return F.when(which, F.col(name))

    latencies = Q.quantiles(rows, of("latency_ms"), {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}, "budget")
    out = rows.groupBy("budget").agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if(scored).alias("scored_count"), F.count_if("skipped").alias("skipped_count"), F.count_if(live & F.col("refused")).alias("refused_count"), _r(F.avg(of("prompt_tokens"))).alias("mean_prompt_tokens"),
        _p(of("prompt_tokens"), 0.5).alias("median_prompt_tokens"), _p(of("prompt_tokens"), 0.95).alias("p95_prompt_tokens"), _r(F.avg(of("latency_ms"))).alias("mean_latency_ms"), _r(F.avg(of("packed_chunks"))).alias("mean_packed_chunks"), _r(F.avg(of("ndcg", scored))).alias("mean_ndcg"), _r(F.count_if(live & F.col("refused")) / F.count(F.lit(1))).alias("refusal_rate"),
    )
    return out.join(latencies, "budget", "left")


def generation_summary(rows: DataFrame) -> DataFrame:
    """rows: skipped, refused, four scores, latency_ms, prompt_tokens, generated_tokens, note_paths. Means over scored rows, tokens over all, distinct notes."""
    scored = ~F.col("skipped")
    scores = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
    whole = rows.agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if(scored).alias("scored_count"), F.count_if("skipped").alias("skipped_count"), F.count_if("refused").alias("refused_count"), *[_r(F.avg(F.when(scored, F.col(s)))).alias(s) for s in scores],
        _r(F.avg(F.when(scored, F.col("latency_ms")))).alias("mean_latency_ms"), *[a for t in ("prompt_tokens", "generated_tokens") for a in (F.coalesce(F.sum(t), F.lit(0)).alias(f"total_{t}"), _r(F.avg(t)).alias(f"mean_{t}"), _p(F.col(t), 0.5).alias(f"median_{t}"))],
    )
    notes = rows.select(F.explode("note_paths").alias("p")).agg(F.count_distinct("p").alias("notes_processed"))
    return whole.crossJoin(notes)  # one row each


def skip_reasons(rows: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent reasons of skipped rows."""
    return rows.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def latency_percentiles(rows: DataFrame, by: str) -> DataFrame:
    v = F.col("latency_ms")
    return rows.groupBy(by).agg(F.count(v).alias("requests"), _r(F.avg(v)).alias("mean")).join(Q.quantiles(rows, v, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by), by, "left")


def score_spread(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Population standard deviation, null for fewer than two scores."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), _r(F.when(F.count(value) >= 2, F.stddev_pop(value))).alias("spread"))


def run_metrics(summary: DataFrame, duration: Column) -> DataFrame:
    """Adds questions_per_second (null without a duration) and scored_ratio."""
    return summary.withColumn("questions_per_second", F.when(duration > 0, _r(F.col("question_count") / duration))).withColumn("scored_ratio", _r(F.when(F.col("question_count") > 0, F.col("scored_count") / F.col("question_count")).otherwise(0.0)))


SCORES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def score_generation(rows: DataFrame) -> DataFrame:
    """One row a question with its four scores, or skipped with a reason. ``rows``: query_id, call_error, refused, refusal_reason, answer, judge_error, and the scores.

    In this order a failed call, a refusal or empty answer, a failed judge, and a score that is no number from 0 to 1 make a question a skipped one."""
    empty = F.col("answer").isNull() | (P.stripped(F.col("answer")) == "")
    bad = F.lit(False)
    for s in SCORES:
        bad = bad | P.unit_score(F.col(s)).isNull()
    reason = F.when(F.col("call_error").isNotNull(), F.col("call_error")).when(F.coalesce("refused", F.lit(False)) | empty, F.coalesce("refusal_reason", F.lit("refused or empty answer")))
    reason = reason.when(F.col("judge_error").isNotNull(), F.col("judge_error")).when(bad, "a score is not from 0 to 1")
    return rows.withColumn("reason", reason).select("query_id", F.col("reason").isNotNull().alias("skipped"), "reason", *[F.when(F.col("reason").isNull(), F.col(s)).alias(s) for s in SCORES])


def budget_grid(ranked: DataFrame, gold: DataFrame, budgets: list[int], k: int) -> DataFrame:
    """Every question under every token budget: query_id, budget, packed_chunks, est_tokens, ndcg and mrr at k of the packed notes, each counted once.

    ``ranked``: query_id, rank, key (the note), text; ``gold``: query_id, key. Budgets are a few settings, exploded beside each ranked chunk."""
    wide = ranked.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])))
    packed = S.pack(wide, F.col("budget").cast("int"), ("query_id", "budget"))
    each = F.struct("query_id", "budget").alias("query_id")
    asked = wide.select("query_id", "budget").distinct()
    own = W.partitionBy("query_id").orderBy("first")
    notes = packed.select(each, "key", "rank").groupBy("query_id", "key").agg(F.min("rank").alias("first")).withColumn("rank", F.row_number().over(own)).drop("first")
    wanted = gold.distinct().join(asked, "query_id").select(each, "key")
    scores = X.questions(notes, wanted, asked.select(each), k).select("query_id.query_id", "query_id.budget", "ndcg", "mrr")
    sizes = packed.groupBy("query_id", "budget").agg(F.count(F.lit(1)).alias("packed_chunks"), F.sum("tokens").alias("est_tokens"))
    return scores.join(sizes, ["query_id", "budget"], "left").na.fill(0, ["packed_chunks", "est_tokens"])


def two_pass(canonical: DataFrame, paraphrases: DataFrame, threshold: float) -> DataFrame:
    """All canonical queries first, which fill the cache, then all paraphrases against it: group_id, query_id, pass, hit, entry_id, similarity. Both: group_id, query_id, vector."""
    hits = S.cache_lookup(paraphrases.select("query_id", "vector"), canonical.select(F.col("query_id").alias("entry_id"), "vector"), threshold)
    first = canonical.select("group_id", "query_id", F.lit("canonical").alias("pass"), F.lit(False).alias("hit"), F.lit(None).cast("long").alias("entry_id"), F.lit(None).cast("double").alias("similarity"))
    second = paraphrases.select("group_id", "query_id").join(hits, "query_id", "left").select("group_id", "query_id", F.lit("paraphrase").alias("pass"), F.col("entry_id").isNotNull().alias("hit"), "entry_id", "similarity")
    return first.unionByName(second)


def query_artifacts(rows: DataFrame, run: str, *order: str) -> DataFrame:
    """A record for each query of a run: its step (from 0) in the run's order, and its hit as 0 or 1. ``rows``: run, order, hit, ..."""
    return rows.withColumn("step", F.row_number().over(W.partitionBy(run).orderBy(*order)) - 1).withColumn("hit", F.coalesce(F.col("hit").cast("int"), F.lit(0)))


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)
