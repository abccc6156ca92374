"""Typed blocks of hand-written notes."""

from marginalia.operators import blocks

NOTE = "lead\n\n# One\ntext\nmore\n- item\n* item\n12. item\n1. no item\n| a | b |\n| c |\n```py\n# not a heading\n\n- not an item\n```\nafter\n## Two ##\n~~~\nx\n```\n\n### Three\n```\nnever closed\n# still code"


def test_blocks_in_one_walk(spark):
    notes = spark.createDataFrame([(1, NOTE), (2, None), (3, ""), (4, "a\r\nb"), (None, "# x"), (5, "\n\n  \n")], "note_id long, note string")
    got = {}
    for r in blocks.typed_blocks(notes).orderBy("note_id", "section_no", "block_no").collect():
        got.setdefault(r["note_id"], []).append(r)
    assert [(r["section_no"], r["block_no"], r["kind"], r["level"], r["first_line"], r["last_line"], r["text"].split("\n")[0]) for r in got[1]] == [
        (0, 0, "paragraph", None, 1, 1, "lead"), (1, 0, "heading", 1, 3, 3, "# One"), (1, 1, "paragraph", None, 4, 5, "text"), (1, 2, "list", None, 6, 6, "- item"), (1, 3, "list", None, 7, 7, "* item"), (1, 4, "list", None, 8, 8, "12. item"),
        (1, 5, "paragraph", None, 9, 9, "1. no item"), (1, 6, "table", None, 10, 10, "| a | b |"), (1, 7, "table", None, 11, 11, "| c |"), (1, 8, "code", None, 12, 16, "```py"), (1, 9, "paragraph", None, 17, 17, "after"),
        (2, 0, "heading", 2, 18, 18, "## Two ##"), (2, 1, "code", None, 19, 21, "~~~"), (3, 0, "heading", 3, 23, 23, "### Three"),
    ]
    for r in got[1]:
        assert NOTE[r["start_offset"] : r["end_offset"]].strip() == r["text"].strip()
    assert [(r["text"], r["start_offset"], r["end_offset"]) for r in got[4]] == [("a\nb", 0, 3)] and got[None][0]["kind"] == "heading"
    assert set(got) == {1, 4, None}
    by = {r["kind"]: r for r in blocks.by_type(blocks.typed_blocks(notes)).collect()}
    assert by["list"]["blocks"] == 3 and by["table"]["blocks"] == 2 and all(r["invalid_offset_count"] == 0 for r in by.values())
    assert blocks.typed_blocks(notes.limit(0)).count() == 0
