"""Typed blocks of notes in one walk over their lines: headings, code, list items, table rows and paragraphs, with places and sections.

A table function is called laterally with each note and yields its blocks, so nothing is shuffled. Unlike the windows of ``markdown`` one walk decides fences, sections
and blocks together, and code stands in the same sequence as what surrounds it.

A block ends with its last line's break. A fence that never closes is no block, nor is anything after it. Cases: a null note has no line; an empty one has one empty line and no block.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from marginalia.functions import text as T
from marginalia.operators import markdown as M

FIELDS = "note_id long, section_no int, block_no int, kind string, level int, first_line int, last_line int, start_offset long, end_offset long, text string"
_HEADING, _ITEM = re.compile(M.HEADING), re.compile(r"[-*+] |\d{2}\.")


class _Walk:
    """A table function: the blocks of one note."""

    def eval(self, note_id: int, note: str):
        if note is None:
            return
        lines, section, block, offset = note.split("\n"), 0, 0, 0
        held: list[tuple[int, int, str]] = []  # lines of an open paragraph or fence: (line, begin, text)
        fenced, last = False, len(lines)

        def made(kind: str, first: int, upto: int, begin: int, end: int, text: str, level: int | None = None):
            return note_id, section, block, kind, level, first, upto, begin, end, text

        for line, text in enumerate(lines, 1):
            begin, offset = offset, offset + len(text) + (line < last)
            bare = text.strip()
            mark = bare[:3] in ("```", "~~~")
            heading = None if mark or fenced or not bare.startswith("#") else _HEADING.match(text)
            plain = not mark and heading is None and bare and not (_ITEM.match(bare) or (bare[0] == "|" and bare[-1] == "|"))
            if fenced or plain:
                held.append((line, begin, text))
                if mark:
                    yield made("code", held[0][0], line, held[0][1], offset, "\n".join(x[2] for x in held).strip())
                    held, fenced, block = [], False, block + 1
                continue
            if held:
                yield made("paragraph", held[0][0], held[-1][0], held[0][1], held[-1][1] + len(held[-1][2]) + 1, "\n".join(x[2] for x in held).strip())
                held, block = [], block + 1
            if mark:
                held, fenced = [(line, begin, text)], True
            elif heading is not None:
                section, block = section + 1, 0
                yield made("heading", line, line, begin, offset, text, len(heading[1]))
                block = 1
            elif bare:
                yield made("list" if _ITEM.match(bare) else "table", line, line, begin, offset, bare)
                block += 1
        if held and not fenced:
            yield made("paragraph", held[0][0], held[-1][0], held[0][1], offset, "\n".join(x[2] for x in held).strip())


def typed_blocks(notes: DataFrame, text_col: str = "note") -> DataFrame:
    """FIELDS: the blocks of notes (note_id, note), numbered within each section (0 before the first heading)."""
    rows = notes.select(F.col("note_id").alias("of_note"), T.unix_lines(F.col(text_col)).alias("of_text"))
    walk = F.udtf(_Walk, returnType=FIELDS)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return rows.lateralJoin(walk(F.col("of_note").outer(), F.col("of_text").outer())).select(*names)


def by_type(blocks: DataFrame) -> DataFrame:
    """Per kind: how many blocks in how many notes and sections, their characters, and blocks whose places are not in order."""
    return blocks.groupBy("kind").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("note_id").alias("notes"), F.count_distinct("note_id", "section_no").alias("sections"),
        F.sum(F.col("end_offset") - F.col("start_offset")).alias("characters"), F.count_if(F.col("start_offset") >= F.col("end_offset")).alias("invalid_offset_count"),
    )
