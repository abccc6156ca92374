"""Structure of notes made of the documents."""

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import markdown as M, statistics as S
from marginalia.plans.corpus import _COUNTS, _WORDS, stats_sql
from marginalia.plans.registry import NOTES_SQL, notes, query

_LINES = f"""WITH {NOTES_SQL}, l AS (SELECT note_id, string_split(note, chr(10)) AS ls FROM notes), x AS (SELECT note_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM l),
f AS (SELECT *, regexp_matches(text, '^\\s*(```|~~~)') AS is_fence FROM x),
o AS (SELECT *, NOT is_fence AND sum(is_fence::int) OVER (PARTITION BY note_id ORDER BY line) % 2 = 0 AS outside, coalesce(sum(length(text) + 1) OVER (PARTITION BY note_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
lines AS (SELECT *, CASE WHEN outside AND regexp_matches(text, '^ {{0,3}}(#{{1,6}})([ \\t]+(.*?)|[ \\t]*)$') THEN length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})', 1)) END AS level,
 CASE WHEN outside AND regexp_matches(text, '^ {{0,3}}(#{{1,6}})([ \\t]+(.*?)|[ \\t]*)$') THEN trim(regexp_extract(text, '^ {{0,3}}(#{{1,6}})(?:[ \\t]+(.*?)|[ \\t]*)$', 2)) END AS title FROM o)"""
_SECTIONS = _LINES + """, n AS (SELECT *, count(level) OVER (PARTITION BY note_id ORDER BY line) AS section_no FROM lines),
s AS (SELECT note_id, section_no, max(level) AS level, max(title) AS title, min(line) AS start_line, max(line) AS end_line,
 regexp_replace(coalesce(string_agg(CASE WHEN level IS NULL THEN text END, chr(10) ORDER BY line), ''), '^\\s+|\\s+$', '', 'g') AS body FROM n GROUP BY note_id, section_no)"""


def _lines(spark, sf_dir):
    return M.lines(notes(spark, sf_dir))


@query(_LINES + " SELECT note_id, line, level, title FROM lines WHERE level IS NOT NULL")
def headings(spark, sf_dir):
    return M.headings(_lines(spark, sf_dir))


@query(f"""WITH {NOTES_SQL}, l AS (SELECT note_id, string_split(note, '. ') AS ls FROM notes), x AS (SELECT note_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM l)
SELECT note_id, line, (line // 3) % 2 = 1 AS opens, ((line // 3 + 1) // 2)::bigint AS pair FROM x WHERE line % 3 = 0""")
def fences(spark, sf_dir):
    """Every third sentence of a note is made a fence."""
    pieces = F.transform(F.split("note", r"\. ", -1), lambda x, i: F.when((i + 1) % 3 == 0, "```").otherwise(F.regexp_replace(x, "\n", " ")))
    fenced = notes(spark, sf_dir).select("note_id", F.array_join(pieces, "\n").alias("note"))
    return M.fences(M.lines(fenced))


@query(_LINES + r" SELECT note_id, line, 0 AS place, trim(split_part(regexp_extract(text, '\[\[([^\]]+)\]\]', 1), '|', 1)) AS target, trim(split_part(regexp_extract(text, '\[\[([^\]]+)\]\]', 1), '|', 2)) AS alias FROM lines WHERE outside AND regexp_matches(text, '(^|[^!])\[\[[^\]]+\]\]')")
def wikilinks(spark, sf_dir):
    return M.links(_lines(spark, sf_dir))


@query(_LINES.replace("- [[", "- ![[") + r" SELECT note_id, line, trim(split_part(regexp_extract(text, '!\[\[([^\]]+)\]\]', 1), '|', 1)) AS target FROM lines WHERE outside AND regexp_matches(text, '!\[\[[^\]]+\]\]')")
def image_links(spark, sf_dir):
    embedded = notes(spark, sf_dir).withColumn("note", F.replace("note", F.lit("- [["), F.lit("- ![[")))
    return M.links(M.lines(embedded), M.IMAGE).select("note_id", "line", "target")


@query(_SECTIONS + """ SELECT a.note_id, a.section_no, a.level, a.title, a.start_line, a.end_line,
 coalesce((SELECT min(b.start_line) - 1 FROM s b WHERE b.note_id = a.note_id AND b.start_line > a.start_line AND b.level <= a.level), (SELECT max(b.end_line) FROM s b WHERE b.note_id = a.note_id)) AS full_end_line,
 length(a.body)::bigint AS body_chars, sha256(a.body) AS body_hash FROM s a""")
def heading_sections(spark, sf_dir):
    return M.sections(_lines(spark, sf_dir)).select("note_id", "section_no", "level", "title", "start_line", "end_line", "full_end_line", F.length("body").cast("long").alias("body_chars"), F.sha2("body", 256).alias("body_hash"))


@query(_SECTIONS + """ SELECT a.note_id, a.section_no, coalesce((SELECT max(b.start_line) FROM s b WHERE b.note_id = a.note_id AND b.start_line < a.start_line AND b.level < a.level), 0) AS parent_line,
 CASE WHEN a.level = 1 THEN a.title ELSE concat((SELECT first(b.title) FROM s b WHERE b.note_id = a.note_id AND b.level = 1), ' / ', a.title) END AS path FROM s a""")
def section_path(spark, sf_dir):
    return M.sections(_lines(spark, sf_dir)).select("note_id", "section_no", F.coalesce("parent_line", F.lit(0)).alias("parent_line"), F.array_join("path", " / ").alias("path"))


@query(_LINES.replace("## '", "# '") + ", h AS (SELECT * FROM lines WHERE level IS NOT NULL) SELECT note_id, line AS start_line, 0::bigint AS parent_line, coalesce(lag(line) OVER (PARTITION BY note_id ORDER BY line), 0) AS previous_line, coalesce(lead(line) OVER (PARTITION BY note_id ORDER BY line), 0) AS next_line FROM h")
def siblings(spark, sf_dir):
    flat = notes(spark, sf_dir).withColumn("note", F.replace("note", F.lit("\n## "), F.lit("\n# ")))
    return M.siblings(M.sections(M.lines(flat))).na.fill(0)


_BLOCKS = _SECTIONS + r""", u AS (SELECT note_id, section_no, level, list_filter(regexp_split_to_array(body, '\n\s*\n'), lambda b: trim(b) <> '' AND NOT regexp_full_match(trim(b), '#{1,6}(\s+.*)?')) AS bs FROM s),
q AS (SELECT note_id, section_no, level, unnest(CASE WHEN len(bs) > 0 THEN bs WHEN level IS NOT NULL THEN [''] ELSE [] END) AS block, unnest(range(0, greatest(len(bs), 1))) AS block_no FROM u),
v AS (SELECT *, """ + _WORDS.format(t="block") + " AS words FROM q), " + "blocks AS (SELECT note_id, section_no, level, block_no, len(words)::bigint AS word_count, length(block)::bigint AS character_count, octet_length(encode(block))::bigint AS byte_count, " + _COUNTS + r""",
 len(regexp_extract_all(block, '\[\[[^\]]+\]\]'))::bigint AS wikilink_count, 0::bigint AS image_embed_count, 0::bigint AS code_block_count, len(list_filter(string_split(block, chr(10)), lambda x: regexp_matches(x, '^\s*([-*+]|\d+[.)])\s+')))::bigint AS list_item_count,
 len(list_filter(string_split(block, chr(10)), lambda x: regexp_matches(x, '^\s*>')))::bigint AS blockquote_line_count FROM v)"""


@query(_BLOCKS + " SELECT * FROM blocks")
def paragraph_blocks(spark, sf_dir):
    return M.paragraphs(M.sections(_lines(spark, sf_dir)))


@query(_BLOCKS + f""" SELECT coalesce('level_' || level, CASE WHEN grouping(level) = 1 THEN 'all_levels' ELSE 'pre_heading' END) AS level_name, {stats_sql('word_count')}, round(avg((word_count = 0)::int), 6)::double AS empty_rate,
 round(avg((word_count > 256)::int), 6)::double AS over_256, round(avg((word_count > 1024)::int), 6)::double AS over_1024, sum(list_item_count)::bigint AS list_items FROM blocks GROUP BY ROLLUP (level)""")
def paragraph_stats_rollup(spark, sf_dir):
    rows = M.paragraphs(M.sections(_lines(spark, sf_dir)))
    name = F.coalesce(F.concat(F.lit("level_"), F.col("level").cast("string")), F.when(F.col("all") == 1, "all_levels").otherwise("pre_heading"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    w = F.col("word_count")
    out = rows.rollup("level").agg(F.grouping("level").alias("all"), *S.distribution(w), share(w == 0).alias("empty_rate"), share(w > 256).alias("over_256"), share(w > 1024).alias("over_1024"), F.sum("list_item_count").alias("list_items"))
    return out.select(name.alias("level_name"), *[c for c in out.columns if c not in ("level", "all")])


@query(_BLOCKS + """ SELECT coalesce('level_' || level, CASE WHEN grouping(level) = 1 THEN 'all_levels' ELSE 'pre_heading' END) AS level_name, round(avg((word_count > 512)::int), 6)::double AS over_512,
 round(coalesce(sum(russian_word_count) / nullif(sum(word_count), 0), 0), 6)::double AS russian_ratio, round(coalesce(sum(english_word_count) / nullif(sum(word_count), 0), 0), 6)::double AS english_ratio,
 round(coalesce(sum(mixed_or_other_word_count) / nullif(sum(word_count), 0), 0), 6)::double AS mixed_or_other_ratio, round(coalesce(sum(unknown_word_count) / nullif(sum(word_count), 0), 0), 6)::double AS unknown_ratio FROM blocks GROUP BY ROLLUP (level)""")
def paragraph_rates(spark, sf_dir):
    rows = M.paragraphs(M.sections(_lines(spark, sf_dir)))
    name = F.coalesce(F.concat(F.lit("level_"), F.col("level").cast("string")), F.when(F.col("all") == 1, "all_levels").otherwise("pre_heading"))
    words = F.sum("word_count")
    ratios = [F.round(F.when(words == 0, 0.0).otherwise(F.sum(f"{k}_word_count") / words), 6).alias(f"{k}_ratio") for k in T.LANGUAGES]
    out = rows.rollup("level").agg(F.grouping("level").alias("all"), F.round(F.avg((F.col("word_count") > 512).cast("int")), 6).alias("over_512"), *ratios)
    return out.select(name.alias("level_name"), *[c for c in out.columns if c not in ("level", "all")])


@query(_LINES + r""", k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^([-*+] |[0-9]{2}\.)') THEN 'list' WHEN starts_with(trim(text), '|') AND ends_with(trim(text), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM lines),
g AS (SELECT *, (lag(kind) OVER w IS NULL OR kind <> lag(kind) OVER w OR kind IN ('list', 'table', 'heading'))::int AS new FROM k WINDOW w AS (PARTITION BY note_id ORDER BY line)),
r AS (SELECT *, sum(new) OVER (PARTITION BY note_id ORDER BY line) AS run FROM g)
SELECT kind, count(DISTINCT (note_id, run)) AS blocks, sum(length(text))::bigint AS characters FROM r WHERE kind <> 'blank' GROUP BY kind""")
def typed_blocks_lines(spark, sf_dir):
    rows = M.line_blocks(_lines(spark, sf_dir)).withColumn("lines", F.col("last_line") - F.col("first_line"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("end_offset") - F.col("start_offset") - F.col("lines")).alias("characters"))


@query(f"""WITH {NOTES_SQL}, l AS (SELECT note_id, string_split(note, '. ') AS ls FROM notes), x AS (SELECT note_id, unnest(range(1, len(ls) + 1)) AS line FROM l)
SELECT note_id, (line // 6)::bigint AS pair, line - 3 AS first_line, line AS last_line FROM x WHERE line % 6 = 0""")
def code_blocks(spark, sf_dir):
    pieces = F.transform(F.split("note", r"\. ", -1), lambda x, i: F.when((i + 1) % 3 == 0, "```").otherwise(F.regexp_replace(x, "\n", " ")))
    return M.code_blocks(M.lines(notes(spark, sf_dir).select("note_id", F.array_join(pieces, "\n").alias("note"))))


@query("SELECT doc_id AS note_id, 'ok' AS status, source AS source_value, lang AS lang_value FROM documents")
def frontmatter(spark, sf_dir):
    headed = notes(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("note_id"), "lang"), "note_id")
    headed = headed.select("note_id", F.concat(F.lit("---\nsource: "), "source", F.lit("\nlang: "), "lang", F.lit("\n---\n"), "note").alias("note"))
    return M.frontmatter(headed).select("note_id", "status", F.col("values")["source"].alias("source_value"), F.col("values")["lang"].alias("lang_value"))


_VIEWS = _SECTIONS + ", lw AS (SELECT note_id, line, level, len(" + _WORDS.format(t="text") + """)::bigint AS w FROM lines),
full_end AS (SELECT a.note_id, a.section_no, a.level, a.start_line, a.end_line, coalesce((SELECT min(b.start_line) - 1 FROM s b WHERE b.note_id = a.note_id AND b.start_line > a.start_line AND b.level <= a.level), (SELECT max(b.end_line) FROM s b WHERE b.note_id = a.note_id)) AS last_line FROM s a),
vw AS (SELECT f.note_id, f.level, 'direct_body' AS view, sum(CASE WHEN lw.level IS NULL THEN w ELSE 0 END)::bigint AS words FROM full_end f JOIN lw ON lw.note_id = f.note_id AND lw.line BETWEEN f.start_line AND f.end_line GROUP BY f.note_id, f.section_no, f.level
 UNION ALL SELECT f.note_id, f.level, 'full_span', sum(w)::bigint FROM full_end f JOIN lw ON lw.note_id = f.note_id AND lw.line BETWEEN f.start_line AND CASE WHEN f.level IS NULL THEN f.end_line ELSE f.last_line END GROUP BY f.note_id, f.section_no, f.level),
hs AS (SELECT note_id, view, level, count(*) AS sections, round(avg(words), 6) AS mean_words, round(median(words)::double, 6) AS median_words FROM vw GROUP BY ALL)"""


@query(_VIEWS + " SELECT note_id, view, coalesce(level, 0) AS level, sections, mean_words, median_words FROM hs")
def heading_statistics(spark, sf_dir):
    return M.heading_statistics(M.sections(_lines(spark, sf_dir))).na.fill(0, ["level"])


@query(_VIEWS + " SELECT coalesce(level, 0) AS level, view, count(*) AS documents, first(mean_words ORDER BY note_id) AS first_mean, first(median_words ORDER BY note_id) AS first_median, round(avg(mean_words), 6) AS average_mean FROM hs GROUP BY ALL")
def section_rows(spark, sf_dir):
    return M.section_rows(M.heading_statistics(M.sections(_lines(spark, sf_dir)))).na.fill(0, ["level"])


_PAGE = "concat_ws(chr(10) || chr(10), CASE WHEN level IS NOT NULL THEN trim(concat(repeat('#', level), ' ', title)) END, CASE WHEN body <> '' THEN body END)"


@query(_SECTIONS + f" SELECT note_id, section_no, sha256({_PAGE}) AS page_hash, length({_PAGE})::bigint AS characters FROM s")
def section_documents(spark, sf_dir):
    return M.section_documents(M.sections(_lines(spark, sf_dir))).select("note_id", "section_no", F.sha2("page", 256).alias("page_hash"), F.length("page").alias("characters"))


@query(_SECTIONS + r""", k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^([-*+] |[0-9]{2}\.)') THEN 'list' WHEN starts_with(trim(text), '|') AND ends_with(trim(text), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM lines),
g AS (SELECT *, (lag(kind) OVER w IS NULL OR kind <> lag(kind) OVER w OR kind IN ('list', 'table', 'heading'))::int AS new FROM k WINDOW w AS (PARTITION BY note_id ORDER BY line)), r AS (SELECT *, sum(new) OVER (PARTITION BY note_id ORDER BY line) AS run FROM g)
SELECT count(DISTINCT note_id) AS documents_processed, count(*) AS sections_total, (SELECT count(DISTINCT (note_id, run)) FROM r WHERE kind <> 'blank') AS blocks_total, 2::bigint AS max_tree_depth, count_if(level IS NOT NULL AND title = '')::bigint AS empty_heading_count, count_if(level IS NULL)::bigint AS pre_heading_count,
 0::bigint AS invalid_offset_count, round(count(level) / count(*), 6)::double AS metadata_completeness FROM s""")
def sectionization(spark, sf_dir):
    """The level stands for a field that only some sections have."""
    rows = _lines(spark, sf_dir)
    return M.sectionization(M.sections(rows), M.line_blocks(rows), "level")


# Sentences become lines; of ten lines one opens and one closes a fence, one is a table row, one an item, one is blank
_MIXED = "list_transform(string_split(note, '. '), lambda x, i: CASE i % 10 WHEN 3 THEN '```' WHEN 6 THEN '~~~' WHEN 7 THEN '| ' || replace(x, chr(10), ' ') || ' |' WHEN 8 THEN '- ' || x WHEN 9 THEN '' ELSE x END)"
_TYPED = _LINES.replace("SELECT note_id, string_split(note, chr(10)) AS ls FROM notes", f"SELECT note_id, string_split(array_to_string({_MIXED}, chr(10)), chr(10)) AS ls FROM notes") + r""",
z AS (SELECT *, count(level) OVER w AS section_no, sum(is_fence::int) OVER w AS n, start + length(text) + (line < max(line) OVER (PARTITION BY note_id))::int AS upto FROM lines WINDOW w AS (PARTITION BY note_id ORDER BY line)),
k AS (SELECT *, CASE WHEN NOT outside THEN 'code' WHEN level IS NOT NULL THEN 'heading' WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^([-*+] |[0-9]{2}\.)') THEN 'list' WHEN starts_with(trim(text), '|') AND ends_with(trim(text), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM z),
g AS (SELECT *, (lag(kind) OVER w IS NULL OR kind <> lag(kind) OVER w OR kind IN ('list', 'table', 'heading'))::int AS new FROM k WINDOW w AS (PARTITION BY note_id ORDER BY line)),
r AS (SELECT *, sum(new) OVER (PARTITION BY note_id ORDER BY line) AS run FROM g),
u AS (SELECT note_id, min(section_no) AS section_no, kind, max(level) AS level, min(line) AS first_line, max(line) AS last_line, min(start) AS start_offset, max(upto) AS end_offset FROM r WHERE kind NOT IN ('blank', 'code') GROUP BY note_id, run, kind
 UNION ALL SELECT note_id, min(section_no), 'code', NULL, min(line), max(line), min(start), max(upto) FROM r WHERE kind = 'code' GROUP BY note_id, (n + 1) // 2 HAVING sum(is_fence::int) = 2),
blocks AS (SELECT note_id, section_no, row_number() OVER (PARTITION BY note_id, section_no ORDER BY start_offset) - 1 AS block_no, kind, level, first_line, last_line, start_offset::bigint AS start_offset, end_offset::bigint AS end_offset FROM u)"""


def _mixed(spark, sf_dir):
    pieces = F.expr("""transform(split(note, '[.] ', -1), (x, i) -> CASE (i + 1) % 10 WHEN 3 THEN '```' WHEN 6 THEN '~~~' WHEN 7 THEN concat('| ', replace(x, chr(10), ' '), ' |') WHEN 8 THEN concat('- ', x) WHEN 9 THEN '' ELSE x END)""")
    return notes(spark, sf_dir).select("note_id", F.array_join(pieces, "\n").alias("note"))


@query(_TYPED + " SELECT * FROM blocks")
def typed_blocks(spark, sf_dir):
    """Every block of notes with fences, table rows, items and headings, in one walk."""
    from marginalia.operators import blocks

    return blocks.typed_blocks(_mixed(spark, sf_dir)).drop("text")


@query(_TYPED + " SELECT kind, count(*) AS blocks, count(DISTINCT note_id) AS notes, count(DISTINCT (note_id, section_no)) AS sections, sum(end_offset - start_offset)::bigint AS characters, 0::bigint AS invalid_offset_count FROM blocks GROUP BY kind")
def sectionization_by_type(spark, sf_dir):
    from marginalia.operators import blocks

    return blocks.by_type(blocks.typed_blocks(_mixed(spark, sf_dir)))
