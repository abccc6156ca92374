"""Splitting notes into chunks, chunk checks and chunking metrics.

The splitter walks a text and cannot be an expression over rows; it runs on Arrow batches of sections, any number of notes a task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marginalia.functions import text as T
from marginalia.operators import markdown as M

SEPARATORS = ("\n\n", "\n", " ", "")
SHORT_FRACTION = 0.25


@dataclass(frozen=True)
class Policy:
    """How to chunk. Sizes are in tokens of ``count_tokens``."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    separators: tuple[str, ...] = SEPARATORS
    preserve_code_blocks: bool = True
    preserve_list_blocks: bool = True
    preserve_table_blocks: bool = True

    def __post_init__(self):
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size or not self.separators:
            raise ValueError("a policy needs a positive size, an overlap below it, and separators")


_TOKEN = re.compile(r"\w+|[^\w\s]")
_LIST_MARK = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")


class _Section:
    """A section's span of its note, cut into spans of it. Nothing is copied or searched: a chunk is a begin and an end, so its place is known."""

    def __init__(self, text: str, policy: Policy):
        self.text, self.policy = text, policy
        self.tokens = [m.start() for m in _TOKEN.finditer(text)]
        self.whole = [(a, b) for kind, a, b in blocks(text) if getattr(policy, f"preserve_{kind}_blocks") and self.size(a, b) <= policy.chunk_size]

    def size(self, a: int, b: int) -> int:
        """Tokens that begin in a span."""
        return bisect_left(self.tokens, b) - bisect_left(self.tokens, a)

    def inside(self, at: int) -> bool:
        """Whether a block that stays whole begins before a place and ends after it."""
        k = bisect_left(self.whole, (at, 0)) - 1
        return k >= 0 and self.whole[k][1] > at

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        body = self.text[a:b]
        return a + len(body) - len(body.lstrip()), a + len(body.rstrip())

    def parts(self, a: int, b: int, separator: str) -> list[tuple[int, int]]:
        """The span cut before each separator that is not within a block that stays whole."""
        if separator:
            cuts = [m.start() for m in re.finditer(re.escape(separator), self.text[a:b])]
        else:
            cuts = range(b - a)
        inner = [a + c for c in cuts if c and not self.inside(a + c)]
        edges = [a, *inner, b]
        return list(zip(edges, edges[1:]))

    def spans(self, a: int, b: int, level: int = 0) -> list[tuple[int, int]]:
        """Spans of at most the policy's tokens where its separators allow that, in order; each begins with as many last parts of the one before as fit the overlap."""
        most, overlap, separators = self.policy.chunk_size, self.policy.chunk_overlap, self.policy.separators
        if self.size(a, b) <= most:
            return [(a, b)]
        if level == len(separators):
            return [(a, b)]
        out: list[tuple[int, int]] = []
        run: deque[tuple[int, int]] = deque()  # adjoining parts of the next span
        for x, y in self.parts(a, b, separators[level]):
            n = self.size(x, y)
            if run and self.size(run[0][0], run[-1][1]) + n > most:
                out.append((run[0][0], run[-1][1]))
                while run and (self.size(run[0][0], run[-1][1]) > overlap or self.size(run[0][0], run[-1][1]) + n > most):
                    run.popleft()
            if n > most:
                out += self.spans(x, y, level + 1)
                run.clear()
            else:
                run.append((x, y))
        if run:
            out.append((run[0][0], run[-1][1]))
        return out


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A plain text's chunks."""
    whole = _Section(text, Policy(size, overlap, separators, False, False, False))
    return [text[a:b] for a, b in (whole.trimmed(*s) for s in whole.spans(0, len(text))) if a < b]


def blocks(text: str) -> list[tuple[str, int, int]]:
    """Kind, begin and end of the code, list and table blocks of a text: a fence with what it holds, and runs of list items or table rows."""
    out: list[tuple[str, int, int]] = []
    at, fence = 0, None
    for line in text.splitlines(keepends=True):
        end, bare = at + len(line.rstrip("\n")), line.strip()
        if bare[:3] in ("```", "~~~"):
            if fence is None:
                fence = at
            else:
                out.append(("code", fence, end))
                fence = None
        elif fence is None:
            kind = "list" if _LIST_MARK.match(line) else "table" if len(bare) > 1 and bare[0] == bare[-1] == "|" else None
            if kind == "table" and out and out[-1][0] == kind and out[-1][2] == at - 1:
                out[-1] = (kind, out[-1][1], end)
            elif kind:
                out.append((kind, at, end))
        at += len(line)
    return out


def chunk_section(level: int | None, title: str | None, source: str, policy: Policy) -> list[tuple[str, int, int]]:
    """(text, begin, end) of a section's chunks; ``source`` is the section's span of the note, its heading line included.

    Code, list items and tables that fit a chunk are not cut. Every chunk of a headed section begins with its heading; the heading is a chunk of its own where the first
    paragraph is too long for one."""
    section = _Section(source, policy)
    head = 0 if level is None else (source.find("\n") + 1 or len(source))
    heading = "" if level is None else f"{'#' * level} {title or ''}".strip()
    found = []
    for span in section.spans(0, len(source)):
        a, b = section.trimmed(*span)
        if a < b:
            own = source[max(a, head) : b].strip() if a < head else source[a:b]
            found.append(("\n\n".join(x for x in (heading, own) if x), a, b))
    return found


SCHEMA = "note_id long, chunk_index int, section_no long, section_title string, section_level int, section_path array<string>, start_offset long, end_offset long, text string"


def chunks(notes: DataFrame, policy: Policy = Policy(), version: str = "v1", parser_version: str = "p1") -> DataFrame:
    """The chunks of notes (note_id, note): SCHEMA, numbered through each note, with word_count, token_count, chunking_version, parser_version, source_content_hash and source_length."""
    whole = M.sections(M.lines(notes)).select("note_id", "section_no", "level", "title", "path", "start_offset", "source")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                level = None if pd.isna(r.level) else int(r.level)
                for k, (text, a, b) in enumerate(chunk_section(level, r.title, r.source, policy)):
                    rows.append((r.note_id, k, r.section_no, r.title, level, list(r.path), r.start_offset + a, r.start_offset + b, text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"section_level": "Int32"})

    made = whole.mapInPandas(run, SCHEMA)
    order = F.row_number().over(M.W.partitionBy("note_id").orderBy("section_no", "chunk_index")) - 1
    counted = made.withColumn("chunk_index", order).withColumns({"word_count": T.chunk_word_count(F.col("text")), "token_count": T.chunk_token_count(F.col("text"))})
    body = T.unix_lines(F.col("note"))
    known = notes.select("note_id", T.content_hash(body).alias("source_content_hash"), F.length(body).cast("long").alias("source_length"))
    return counted.withColumns({"chunking_version": F.lit(version), "parser_version": F.lit(parser_version)}).join(known, "note_id")


def invalid(rows: DataFrame) -> DataFrame:
    """Chunks that break one of the nine rules, with the rules' names."""

    def missing(name: str):
        return F.col(name).isNull() | (F.trim(name) == "")

    rules = {
        "note_id": F.col("note_id").isNull() | (F.col("note_id") < 0), "chunk_index": F.col("chunk_index").isNull() | (F.col("chunk_index") < 0), "text": F.col("text").isNull() | ~F.col("text").rlike(r"\S"),
        "offsets": F.col("start_offset").isNull() | F.col("end_offset").isNull() | (F.col("start_offset") < 0) | (F.col("end_offset") < F.col("start_offset")), "word_count": ~F.col("word_count").eqNullSafe(T.chunk_word_count(F.col("text"))),
        "token_count": ~F.col("token_count").eqNullSafe(T.chunk_token_count(F.col("text"))), "parser_version": missing("parser_version"), "source_content_hash": missing("source_content_hash"), "chunking_version": missing("chunking_version"),
    }
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).where(F.size("broken") > 0)


def metrics(rows: DataFrame, chunk_size: int, *by: str, short: float = SHORT_FRACTION) -> DataFrame:
    """Chunking metrics of a chunk table (token_count, text, start_offset, end_offset, source_length), by group.

    Percentiles are taken from counts by token length (a few thousand values at most), not from the chunks."""
    least = max(1, int(chunk_size * short))
    counts = rows.groupBy(*by, "token_count").agg(F.count(F.lit(1)).alias("n"))
    w = M.W.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("token_count").rowsBetween(M.W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))

    def at(q: float):
        return F.min(F.when(F.col("upto") > F.bround((F.col("all") - 1) * F.lit(q)), F.col("token_count")))

    lengths = ranked.groupBy(*by).agg(F.sum("n").alias("chunks_total"), at(0.5).alias("median_token_length"), at(0.95).alias("p95_token_length"), F.round(F.sum(F.col("n") * F.col("token_count")) / F.sum("n"), 6).alias("mean_token_length"), F.round(F.sum(F.when(F.col("token_count") < least, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("short_rate"))
    bad = (F.col("start_offset") < 0) | (F.col("end_offset") < F.col("start_offset")) | (F.col("end_offset") > F.col("source_length"))
    texts = rows.groupBy(*by, F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(bad).alias("bad"))
    rest = texts.groupBy(*by).agg((F.sum("n") - F.count(F.lit(1))).alias("duplicate_hash_count"), F.sum("bytes").alias("storage_bytes"), F.sum("bad").alias("boundary_violation_count"))
    return lengths.join(rest, list(by)) if by else lengths.crossJoin(rest)


def oversized(sections: DataFrame, policies: DataFrame) -> DataFrame:
    """Per policy (policy, chunk_size): sections over its size. The policies are a short configuration table, so they are exploded beside each section."""
    return sections.crossJoin(F.broadcast(policies)).groupBy("policy").agg(F.count(F.lit(1)).alias("sections"), F.count_if(F.col("token_count") > F.col("chunk_size")).alias("oversized"))


def count_by_version(rows: DataFrame, version: str) -> DataFrame:
    """One row: how many chunks of a version are stored."""
    if not version.strip():
        raise ValueError("a version is not blank")
    return rows.where(F.col("chunking_version") == version).agg(F.count(F.lit(1)).alias("chunks"))


def generation(rows: DataFrame, version: str, *note_ids: int) -> DataFrame:
    """The chunks of some notes in one version, in their order."""
    return rows.where((F.col("chunking_version") == version) & F.col("note_id").isin(*note_ids)).orderBy("note_id", "chunk_index")


def delete_generations(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What stays when whole generations (note_id, chunking_version) are deleted."""
    return rows.join(gone.select("note_id", "chunking_version").distinct(), ["note_id", "chunking_version"], "left_anti")


def materialise(notes: DataFrame, folder: str, policy: Policy, version: str) -> DataFrame:
    """Replace all stored chunks by those of one policy; the stored table."""
    chunks(notes, policy, version).write.mode("overwrite").parquet(folder)
    return notes.sparkSession.read.parquet(folder)


def experiment(notes: DataFrame, policies: dict[str, Policy], short: float = SHORT_FRACTION) -> DataFrame:
    """The notes chunked under each policy, and its metrics: one row a policy. A section is too large when its text has more tokens than a chunk may have."""
    parts = []
    sizes = M.section_documents(M.sections(M.lines(notes))).select(T.chunk_token_count(F.col("page")).alias("tokens"))
    for name, policy in policies.items():
        made = chunks(notes, policy, name)
        fields = ("section_path", "parser_version", "source_content_hash", "chunking_version")
        there = sum((F.col(f).isNotNull().cast("long") for f in fields), F.lit(0))
        complete = made.agg(F.round(F.coalesce(F.sum(there) / (F.count(F.lit(1)) * len(fields)), F.lit(1.0)), 6).alias("metadata_completeness"))
        large = sizes.agg(F.count_if(F.col("tokens") > policy.chunk_size).alias("oversized_sections_total"))
        row = metrics(made, policy.chunk_size, short=short).crossJoin(complete).crossJoin(large)  # one row each
        overlap = (F.lit(policy.chunk_overlap > 0) & (F.col("oversized_sections_total") > 0)).cast("long")
        parts.append(row.select(F.lit(name).alias("policy"), F.lit(max(1, int(policy.chunk_size * short))).cast("long").alias("short_threshold"), overlap.alias("overlap_enabled"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
