"""From ranked chunks to an answer: packing, the score gate, prompts, the answer cache and the answering graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import policies as P, text as T

BUDGET, THRESHOLD = 1200, 0.92


def pack(ranked: DataFrame, budget: int | Column = BUDGET, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The longest prefix of the ranking within a token budget, the first chunk cut to it. ``ranked``: query_id, rank, text, ..."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    body = P.stripped(F.col("text"))
    w = W.partitionBy(*by).orderBy("rank")
    rows = ranked.withColumn("place", F.row_number().over(w)).withColumn("text", body)
    cut = (F.col("place") == 1) & (T.estimated_tokens(F.col("text")) > limit)
    rows = rows.withColumn("text", F.when(cut, F.regexp_replace(F.substring(F.col("text"), F.lit(1), limit * 4), r"\s+$", "")).otherwise(F.col("text")))
    rows = rows.withColumn("tokens", T.estimated_tokens(F.col("text")))
    used = F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where((F.col("used") <= limit) | (F.col("place") == 1)).drop("place")


def gate(asked: DataFrame, ranked: DataFrame, least: float) -> DataFrame:
    """query_id and the refusal reason, null where an answer may be made."""
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    reason = F.when(F.col("best").isNull(), "no retrieved context").when(F.col("best") < least, "retrieved context is below the score threshold")
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", reason.alias("refusal"))


def prompt(asked: DataFrame, packed: DataFrame) -> DataFrame:
    """query_id and the user message: the question, then the packed chunks in order. ``packed``: query_id, rank, chunk_id, note_path, title, text."""
    block = F.concat(F.lit("[chunk_id="), F.col("chunk_id").cast("string"), F.lit(" note_path="), "note_path", F.lit(" title="), "title", F.lit("]\n"), "text")
    found = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("blocks"))
    lines = F.concat(F.array(F.concat(F.lit("Question: "), P.stripped(F.col("question"))), F.lit(""), F.lit("Chunks:")), F.coalesce(F.transform("blocks", lambda x: x["b"]), F.array().cast("array<string>")))
    return asked.join(found, "query_id", "left").select("query_id", F.array_join(lines, "\n").alias("prompt"))


def parse_answers(raw: DataFrame) -> DataFrame:
    """query_id, answer, citations (chunk_id and note_path of known chunks, first mentions), confidence, error. ``raw``: query_id, reply, allowed (array of ids),
    and, where paths are wanted, note_paths (map of these ids to paths).

    Replies may be fenced, wrapped in prose, or hold backslashes that JSON does not allow: these need a parser in Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [_parse(reply, allowed) for reply, allowed in zip(f["reply"], f["allowed"])]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [r[0] for r in rows], "citations": [r[1] for r in rows], "confidence": [r[2] for r in rows], "error": [r[3] for r in rows]})

    made = raw.select("query_id", "reply", "allowed").mapInPandas(run, "query_id long, answer string, citations array<long>, confidence double, error string")
    paths = raw.select("query_id", F.col("note_paths") if "note_paths" in raw.columns else F.lit(None).cast("map<bigint,string>").alias("note_paths"))
    cited = F.transform("citations", lambda c: F.struct(c.alias("chunk_id"), F.col("note_paths")[c].alias("note_path")))
    return made.join(paths, "query_id").select("query_id", "answer", cited.alias("citations"), "confidence", "error")


def _parse(reply: str | None, allowed) -> tuple:
    import json
    import re

    text = (reply or "").strip()
    if m := re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S | re.I):
        text = m[1].strip()
    if 0 <= text.find("{") < text.rfind("}"):
        text = text[text.find("{") : text.rfind("}") + 1]

    def load(s: str):
        try:
            return json.loads(s)
        except ValueError:
            return None

    value = load(text)
    if value is None:  # double each backslash inside a string that starts no valid escape
        string = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
        value = load(string.sub(lambda m: re.sub(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])|\\', lambda e: e[0] if e[1] else "\\\\", m[0]), text))
    error = _broken(value)
    if error:
        return None, [], None, error
    answer, confidence, given = value["answer"], value.get("confidence"), value.get("citations")
    known = set(allowed if allowed is not None else [])
    ids = [c.get("chunk_id") for c in given or [] if isinstance(c, dict)]
    ids = [i for i in dict.fromkeys(i for i in ids if isinstance(i, int) and not isinstance(i, bool)) if i in known]
    return answer.strip(), ids, min(max(float(confidence or 0.0), 0.0), 1.0), None


#: Fields of a reply: their types, and whether they have to be there
REPLY = {"answer": (str, True), "confidence": ((int, float), False), "citations": (list, False)}


def _broken(value) -> str | None:
    """The first thing that is wrong with a parsed reply: what it is, or a field's name."""
    if not isinstance(value, dict):
        return "unreadable reply" if value is None else "reply is no object"
    for name, (kind, needed) in REPLY.items():
        field = value.get(name)
        blank = field is None or isinstance(field, str) and not field.strip()
        if needed and blank or field is not None and (isinstance(field, bool) or not isinstance(field, kind)):
            return f"reply without a usable {name}"
    return None


def cache_lookup(queries: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, entry_id, similarity of the nearest entry, where near enough. ``queries``: query_id, vector; ``entries`` of one pipeline version: entry_id, vector."""
    from marginalia.operators.retrieval import dense

    hits = dense(queries, entries.select(F.col("entry_id").alias("chunk_id"), "vector"), 1)
    return hits.where(F.col("score") >= threshold).select("query_id", F.col("chunk_id").alias("entry_id"), F.col("score").alias("similarity"))


def cache_evict(entries: DataFrame, most: int, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Entries that live on: not expired, and among the last used ``most`` of their version. ``entries``: version, entry_id, last_used, ..."""
    if ttl_seconds is not None and now is not None:
        entries = entries.where(F.col("last_used").cast("timestamp") > now.cast("timestamp") - F.expr(f"interval {ttl_seconds} seconds"))
    w = W.partitionBy("version").orderBy(F.col("last_used").desc(), F.col("entry_id").desc())
    return entries.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def cache_store(entries: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """Entries after new ones are stored; an entry of the same id is replaced."""
    return cache_evict(entries.join(new.select("version", "entry_id"), ["version", "entry_id"], "left_anti").unionByName(new), most)


def cache_touch(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Renew last_used of entries that were hit. ``hits``: version, entry_id, at."""
    latest = hits.groupBy("version", "entry_id").agg(F.max("at").alias("at"))
    return entries.join(latest, ["version", "entry_id"], "left").withColumn("last_used", F.greatest("last_used", "at")).drop("at")


def answer_graph(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], least_score: float = 0.0, cached: DataFrame | None = None) -> DataFrame:
    """The answering graph as columns: query_id, path (steps joined by '>'), answer, refused, retries.

    ``questions``: query_id, query. ``retrieve`` maps (query_id, query) to (query_id, best, context); ``generate`` maps (query_id, query, context) to
    (query_id, answer, confidence, n_citations). A failed answer is tried once more with a rewritten query: the second attempt is a branch for the
    failed rows, so there is no loop. Each attempt is written, a row a question, so retrieval and generation run once for it; without failed rows there is no second one."""
    from marginalia.sources.storage import settle

    rows = questions
    hit = F.lit(False)
    if cached is not None:  # query_id, cached_answer
        rows = rows.join(cached.select("query_id", "cached_answer"), "query_id", "left")
        hit = F.col("cached_answer").isNotNull()
    else:
        rows = rows.withColumn("cached_answer", F.lit(None).cast("string"))
    rows = rows.withColumn("hit", hit).withColumn("label", P.query_label(F.col("query")))

    def attempt(some: DataFrame, steps: str) -> DataFrame:
        found = settle(some.join(retrieve(some.select("query_id", "query")), "query_id", "left"), "retrieved")
        made = generate(found.where(F.col("best") >= least_score).select("query_id", "query", "context"))
        joined = found.select("query_id", "query", "best").join(made, "query_id", "left")
        refused = F.col("best").isNull() | (F.col("best") < least_score)
        ok = P.self_check_ok(F.col("answer"), F.coalesce("confidence", F.lit(0.0)), F.col("n_citations"), refused)
        path = F.when(refused, f"{steps}retrieve>rerank>gate>refuse").otherwise(f"{steps}retrieve>rerank>gate>generate>self_check")
        return settle(joined.select("query_id", "query", path.alias("path"), F.when(~refused, F.col("answer")).alias("answer"), refused.alias("refused"), ok.alias("ok")), "attempt")

    ends = rows.where(F.col("hit")).select("query_id", F.lit("semantic_cache_lookup").alias("path"), F.col("cached_answer").alias("answer"), F.lit(False).alias("refused"), F.lit(0).alias("retries"))
    turned_away = rows.where(~F.col("hit") & (F.col("label") == "refuse")).select("query_id", F.lit("semantic_cache_lookup>classify>refuse").alias("path"), F.lit(None).cast("string").alias("answer"), F.lit(True).alias("refused"), F.lit(0).alias("retries"))
    first = attempt(rows.where(~F.col("hit") & (F.col("label") == "rag_qa")).select("query_id", "query"), "semantic_cache_lookup>classify>")
    good = first.where("ok").select("query_id", F.when(F.col("refused"), F.col("path")).otherwise(F.concat("path", F.lit(">semantic_cache_write"))).alias("path"), "answer", "refused", F.lit(0).alias("retries"))
    if first.where("NOT ok").isEmpty():
        return ends.unionByName(turned_away).unionByName(good)
    again = first.where("NOT ok").select("query_id", P.rewritten(F.col("query"), F.lit(0)).alias("query"), F.col("path").alias("before"))
    second = attempt(again.select("query_id", "query"), ">rewrite>").join(again.select("query_id", "before"), "query_id")
    written = F.when(F.col("refused"), F.concat("before", "path")).otherwise(F.concat("before", "path", F.lit(">semantic_cache_write")))
    last = second.select("query_id", written.alias("path"), "answer", "refused", F.lit(1).alias("retries"))
    return ends.unionByName(turned_away).unionByName(good).unionByName(last)
