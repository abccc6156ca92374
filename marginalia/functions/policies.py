"""Rules of the answering graph: which queries to take, how to rewrite one, which answers to accept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAST_CONFIDENCE, RETRIES = 0.4, 1
HINT = "(кратко по заметкам vault, ключевые термины)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def query_reason(query: Column) -> Column:
    return F.when(F.length(stripped(query)) < 3, "query too short").when(~query.rlike(r"\p{L}"), "query has no letters").otherwise("looks like a vault question")


def query_label(query: Column) -> Column:
    return F.when((F.length(stripped(query)) < 3) | ~query.rlike(r"\p{L}"), "refuse").otherwise("rag_qa")


def rewritten(query: Column, attempt: Column) -> Column:
    clean = stripped(F.regexp_replace(query, r"\s+", " "))
    return F.when(attempt <= 0, F.concat(clean, F.lit(" " + HINT))).otherwise(clean)


def self_check_reason(answer: Column, confidence: Column, n_citations: Column, refused: Column) -> Column:
    empty = answer.isNull() | (stripped(answer) == "")
    return F.when(refused, "refused path needs no answer check").when(empty, "empty answer").when(confidence < LEAST_CONFIDENCE, "low confidence").when(F.coalesce(n_citations, F.lit(0)) == 0, "missing citations").otherwise("answer looks grounded")


def self_check_ok(answer: Column, confidence: Column, n_citations: Column, refused: Column) -> Column:
    return self_check_reason(answer, confidence, n_citations, refused).isin("refused path needs no answer check", "answer looks grounded")


def gate_tokens(trace: Column) -> Column:
    return F.regexp_extract(trace, r"est_tokens=(\d+)", 1).try_cast("long")


def gate_packed(trace: Column) -> Column:
    return F.regexp_extract(trace, r"packed=(\d+)", 1).try_cast("long")


def _number(reply: Column, field: str) -> tuple[Column, Column]:
    """A field of a JSON object as double, and whether it is a number there (not a text, not true or false)."""
    value = F.try_variant_get(reply, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    return F.try_variant_get(reply, f"$.{field}", "double"), F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False))


def judge_scores(reply: Column) -> Column:
    """A judge's reply to a struct of faithfulness and answer_relevancy, whole numbers from 0 to 5, and error; both scores are null with an error."""
    parsed = F.try_parse_json(reply)
    error = F.when(parsed.isNull(), "not JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    values = []
    for field in ("faithfulness", "answer_relevancy"):
        value, number = _number(parsed, field)
        error = error.when(~number | (value != F.floor(value)), f"{field} is not a whole number").when(~value.between(0, 5), f"{field} is not from 0 to 5")
        values.append(value.cast("long"))
    return F.struct(F.when(error.isNull(), values[0]).alias("faithfulness"), F.when(error.isNull(), values[1]).alias("answer_relevancy"), error.alias("error"))


def unit_score(value: Column) -> Column:
    """A score from 0 to 1, else null; NaN is none."""
    return F.when(~F.isnan(value) & value.between(0.0, 1.0), value)
