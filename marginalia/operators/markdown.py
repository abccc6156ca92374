"""Markdown structure of notes: lines, fences, headings, links, sections, paragraphs.

Notes (note_id, note) become rows of lines; everything below is windows over the lines of a note, so a note is shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import text as T
from marginalia.functions.policies import stripped

#: Markdown patterns
FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?)|[ \t]*)$"
WIKILINK = r"(?<!!)\[\[([^\]]+)\]\]"
IMAGE = r"!\[\[([^\]]+)\]\]"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+"
QUOTE = r"^\s*>"
EMPTY_HEADING = "__empty_heading__"


def _own():
    return W.partitionBy("note_id").orderBy("line")


def _so_far():
    return _own().rowsBetween(W.unboundedPreceding, 0)


def _before():
    return _own().rowsBetween(W.unboundedPreceding, -1)


def lines(notes: DataFrame, text_col: str = "note") -> DataFrame:
    """note_id, line (from 1), text, is_fence, outside (not in a fence nor one), heading_level and heading (null for other lines), start (offset)."""
    rows = notes.select("note_id", F.posexplode(F.split(T.unix_lines(F.col(text_col)), "\n", -1)).alias("at", "text")).select("note_id", (F.col("at") + 1).alias("line"), "text")
    rows = rows.withColumn("is_fence", F.col("text").rlike(FENCE))
    rows = rows.withColumn("outside", ~F.col("is_fence") & (F.sum(F.col("is_fence").cast("int")).over(_so_far()) % 2 == 0))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(_before()), F.lit(0)))
    is_heading = F.col("outside") & F.col("text").rlike(HEADING)
    return rows.withColumn("heading_level", F.when(is_heading, F.length(F.regexp_extract("text", HEADING, 1)))).withColumn("heading", F.when(is_heading, F.trim(F.regexp_extract("text", HEADING, 2))))


def headings(rows: DataFrame) -> DataFrame:
    return rows.where("heading_level IS NOT NULL").select("note_id", "line", F.col("heading_level").alias("level"), F.col("heading").alias("title"))


def fences(rows: DataFrame) -> DataFrame:
    """Fence lines: which of them open, and the place of the pair."""
    n = F.sum(F.col("is_fence").cast("int")).over(_so_far())
    return rows.withColumn("n", n).where("is_fence").select("note_id", "line", (F.col("n") % 2 == 1).alias("opens"), F.ceil(F.col("n") / 2).cast("long").alias("pair"))


def links(rows: DataFrame, pattern: str = WIKILINK) -> DataFrame:
    """note_id, line, target and alias (null without one) of links outside fences."""
    found = rows.where("outside").select("note_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("place", "inner"))
    parts = F.split("inner", r"\|", 2)
    return found.select("note_id", "line", "place", F.trim(parts[0]).alias("target"), F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(1)))).alias("alias"))


def sections(rows: DataFrame) -> DataFrame:
    """One row per section: section_no (0 before the first heading), level, title, start_line, end_line (direct), full_end_line, parent_line,
    path, direct body, and source (all its direct lines). A section without a heading exists only where there are lines before the first heading."""
    numbered = rows.withColumn("section_no", F.count("heading_level").over(_so_far()))
    every = F.array_sort(F.collect_list(F.struct("line", "text", "heading_level")))
    pieces = F.filter(every, lambda x: x["heading_level"].isNull())
    base = numbered.groupBy("note_id", "section_no").agg(
        F.min("line").alias("line"), F.max("line").alias("end_line"), F.max("heading_level").alias("level"), F.max("heading").alias("title"), F.min("start").alias("start_offset"),
        F.max(F.col("start") + F.length("text")).alias("end_offset"), F.array_join(F.transform(every, lambda x: x["text"]), "\n").alias("source"), stripped(F.array_join(F.transform(pieces, lambda x: x["text"]), "\n")).alias("body"),
    )
    named = F.when(F.col("level").isNotNull(), F.when(F.col("title") == "", EMPTY_HEADING).otherwise(F.col("title")))
    base = base.withColumn("name", named).withColumn("last_line", F.max("end_line").over(W.partitionBy("note_id")))
    last = {k: F.max(F.when(F.col("level") == k, F.col("line"))).over(_before()) for k in range(1, 7)}
    names = {k: F.last(F.when(F.col("level") == k, F.col("name")), True).over(_before()) for k in range(1, 7)}
    after = _own().rowsBetween(1, W.unboundedFollowing)
    ends = {k: F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, 7)}
    wide = base.select("*", *[last[k].alias(f"l{k}") for k in last], *[names[k].alias(f"n{k}") for k in names], *[ends[k].alias(f"e{k}") for k in ends])

    def live(k: int) -> Column:  # the last heading of level k is above this one
        newer = F.greatest(F.lit(0), *[F.coalesce(F.col(f"l{j}"), F.lit(0)) for j in range(1, k)]) if k > 1 else F.lit(0)
        return F.col(f"l{k}").isNotNull() & (F.lit(k) < F.col("level")) & (F.col(f"l{k}") > newer)

    parent = F.greatest(F.lit(0), *[F.when(live(k), F.col(f"l{k}")).otherwise(0) for k in range(1, 7)])
    path = F.concat(*[F.when(live(k), F.array(F.col(f"n{k}"))).otherwise(F.array().cast("array<string>")) for k in range(1, 7)], F.array("name"))
    full = F.coalesce(F.when(F.col("level").isNotNull(), F.get(F.array(*[F.col(f"e{k}") for k in range(1, 7)]), F.col("level") - 1)) - 1, F.when(F.col("level").isNull(), F.col("end_line")), F.col("last_line"))
    return wide.select("note_id", "section_no", "level", "title", F.col("line").alias("start_line"), "end_line", full.alias("full_end_line"), F.when(parent > 0, parent).alias("parent_line"), F.when(F.col("level").isNotNull(), path).otherwise(F.array().cast("array<string>")).alias("path"), "start_offset", "end_offset", "source", "body")


def siblings(found: DataFrame) -> DataFrame:
    """The previous and next section of the same parent."""
    own = W.partitionBy("note_id", "parent_line").orderBy("start_line")
    heads = found.where("level IS NOT NULL")
    return heads.select("note_id", "start_line", "parent_line", F.lag("start_line").over(own).alias("previous_line"), F.lead("start_line").over(own).alias("next_line"))


def paragraphs(found: DataFrame) -> DataFrame:
    """Blank-line blocks of the sections' bodies; a headed section without any has one empty block."""
    blocks = F.filter(F.split("body", r"\n\s*\n"), lambda b: (F.trim(b) != "") & ~stripped(b).rlike(r"^\s{0,3}#{1,6}(?:\s+.*)?$"))
    filled = F.when(F.size(blocks) > 0, blocks).when(F.col("level").isNotNull(), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    rows = found.select("note_id", "section_no", "level", F.posexplode(filled).alias("block_no", "block"))

    def lines_like(pattern: str) -> Column:
        return F.size(F.filter(F.split("block", "\n"), lambda x: x.rlike(pattern))).cast("long")

    line = T.word_line(F.col("block"))
    return rows.select(
        "note_id", "section_no", "level", "block_no", F.length("block").cast("long").alias("character_count"), F.octet_length("block").cast("long").alias("byte_count"), *T.language_counts(line),
        F.regexp_count("block", F.lit(WIKILINK)).cast("long").alias("wikilink_count"), F.regexp_count("block", F.lit(IMAGE)).cast("long").alias("image_embed_count"), F.floor(lines_like(FENCE) / 2).alias("code_block_count"),
        lines_like(LIST_ITEM).alias("list_item_count"), lines_like(QUOTE).alias("blockquote_line_count"),
    )


def line_blocks(rows: DataFrame) -> DataFrame:
    """Blocks that lines alone decide, outside fences: lists, table rows and paragraphs (runs of other lines), by gaps and islands."""
    s = stripped(F.col("text"))
    kind = F.when(~F.col("outside"), "code").when(F.col("heading_level").isNotNull(), "heading").when(s == "", "blank").when(s.rlike(r"^(?:[-*+] |\p{Nd}{2}\.)"), "list").when(s.startswith("|") & s.endswith("|"), "table").otherwise("paragraph")
    typed = rows.withColumn("kind", kind).withColumn("new", (F.lag("kind").over(_own()).isNull() | (F.col("kind") != F.lag("kind").over(_own())) | F.col("kind").isin("list", "table", "heading")).cast("int"))
    run = typed.withColumn("run", F.sum("new").over(_so_far())).where("kind NOT IN ('blank', 'code')")
    return run.groupBy("note_id", "run", "kind").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min("start").alias("start_offset"), F.max(F.col("start") + F.length("text")).alias("end_offset"))


def code_blocks(rows: DataFrame) -> DataFrame:
    """Closed fences as blocks; an unclosed one makes none."""
    opened = fences(rows).groupBy("note_id", "pair").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n"))
    return opened.where("n = 2").select("note_id", "pair", "first_line", "last_line")


def frontmatter(notes: DataFrame, text_col: str = "note") -> DataFrame:
    """note_id, status (none, ok, unclosed, not_a_mapping, malformed) and the mapping as JSON strings by key. YAML needs a Python parser."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_frontmatter(x or "") for x in batch["note"]]
            yield pd.DataFrame({"note_id": batch["note_id"], "status": [s for s, _ in found], "values": [v for _, v in found]})

    return notes.select("note_id", F.col(text_col).alias("note")).mapInPandas(parse, "note_id long, status string, values map<string,string>")


def _frontmatter(note: str) -> tuple[str, dict[str, str]]:
    import json
    import re

    first, *rest = note.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if first.strip() != "---":
        return "none", {}
    end = next((i for i, x in enumerate(rest) if re.fullmatch(r"(?:---|\.\.\.)[ \t]*", x)), None)
    if end is None:
        return "unclosed", {}
    body = "\n".join(rest[:end])
    try:
        import yaml

        value = yaml.safe_load(body)
    except ImportError:  # plain "key: value" lines
        value = dict(tuple(p.strip() for p in x.split(":", 1)) for x in rest[:end] if x.strip()) if all(":" in x for x in rest[:end] if x.strip()) else [body]
    except Exception:
        return "malformed", {}
    if value is None:
        return "ok", {}
    if not isinstance(value, dict):
        return "not_a_mapping", {}
    return "ok", {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in value.items()}


def heading_statistics(found: DataFrame) -> DataFrame:
    """Per note, view and level (null before the first heading): sections, mean and median of their words. The direct body ends at the next heading, the full span at the next
    heading of the same or a higher level and holds its headings. ``found``: sections."""
    rows = found.select("note_id", "section_no", "level", "end_line", "full_end_line", T.natural_word_count(F.col("body")).alias("direct"), T.natural_word_count(F.col("source")).alias("own"))
    rows = rows.withColumn("upto", F.sum("own").over(W.partitionBy("note_id").orderBy("section_no")))
    ends = rows.select("note_id", F.col("end_line").alias("full_end_line"), F.col("upto").alias("through"))
    views = F.array(F.struct(F.lit("direct_body").alias("view"), F.col("direct").alias("words")), F.struct(F.lit("full_span").alias("view"), (F.col("through") - F.col("upto") + F.col("own")).alias("words")))
    both = rows.join(ends, ["note_id", "full_end_line"]).select("note_id", "level", F.explode(views).alias("v"))
    return both.groupBy("note_id", "v.view", "level").agg(F.count(F.lit(1)).alias("sections"), F.round(F.avg("v.words"), 6).alias("mean_words"), F.round(F.median("v.words"), 6).alias("median_words"))


def section_rows(statistics: DataFrame) -> DataFrame:
    """Per level and view: notes that have it, the first note's mean and median, and the mean of all notes' means."""
    first = F.min_by(F.struct("mean_words", "median_words"), "note_id")
    return statistics.groupBy("level", "view").agg(F.count(F.lit(1)).alias("documents"), first.alias("f"), F.round(F.avg("mean_words"), 6).alias("average_mean")).select("level", "view", "documents", F.col("f.mean_words").alias("first_mean"), F.col("f.median_words").alias("first_median"), "average_mean")


def section_documents(found: DataFrame) -> DataFrame:
    """Each section as one text, its heading, a blank line and its body, with what is known of it."""
    heading = F.when(F.col("level").isNotNull(), F.trim(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.coalesce("title", F.lit("")))))
    page = F.concat_ws("\n\n", F.when(heading != "", heading), F.when(F.col("body") != "", F.col("body")))
    return found.select("note_id", "section_no", page.alias("page"), F.struct("level", "title", "path", "start_offset", "end_offset").alias("metadata"))


def sectionization(found: DataFrame, blocks: DataFrame, *metadata: str) -> DataFrame:
    """One row over sections and their typed blocks (start_offset, end_offset): how many, how deep, what is empty or has bad offsets, and the share of ``metadata`` that is there."""
    bad = F.col("start_offset") > F.col("end_offset")
    there = sum((F.col(c).isNotNull().cast("long") for c in metadata), F.lit(0))
    whole = found.agg(
        F.count_distinct("note_id").alias("documents_processed"), F.count(F.lit(1)).alias("sections_total"), F.coalesce(F.max(F.size("path")), F.lit(0)).alias("max_tree_depth"), F.count_if(F.col("level").isNotNull() & (F.col("title") == "")).alias("empty_heading_count"),
        F.count_if(F.col("level").isNull()).alias("pre_heading_count"), F.count_if(bad).alias("bad_sections"), F.round(F.coalesce(F.sum(there) / (F.count(F.lit(1)) * max(1, len(metadata))), F.lit(1.0)) if metadata else F.lit(1.0), 6).alias("metadata_completeness"),
    )
    parts = blocks.agg(F.count(F.lit(1)).alias("blocks_total"), F.count_if(bad).alias("bad_blocks"))
    return whole.crossJoin(parts).select("documents_processed", "sections_total", "blocks_total", "max_tree_depth", "empty_heading_count", "pre_heading_count", (F.col("bad_sections") + F.col("bad_blocks")).alias("invalid_offset_count"), "metadata_completeness")  # one row each
