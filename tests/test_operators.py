"""Hand-checked cases of the operators: fixtures of notes, rankings, states, caches, chunks."""

import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import estimated_tokens
from marginalia.operators import chunking as C, embedding as E, ingest as G, markdown as M, metrics as X, retrieval as R, serving as S
from marginalia.sources import evaluation, notes as N
from marginalia.sources.storage import new_folder
from marginalia.streaming import cache, ingest as SI, logs


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def note(spark, text):
    return spark.createDataFrame([(1, text)], "note_id long, note string")


def test_headings_links_and_fences(spark):
    text = "---\ntitle: x\n---\n\n\n\n# Introduction\n[[RAG]] and [[BERT|Encoder model]]\n![[Pasted image.png]]\n```\n# not a heading\n[[no]]\n```\n#\n####### seven\n"
    lines = M.lines(note(spark, text))
    assert [(r["line"], r["level"], r["title"]) for r in rows(M.headings(lines).orderBy("line"))] == [(7, 1, "Introduction"), (14, 1, "")]
    assert [(r["target"], r["alias"]) for r in rows(M.links(lines).orderBy("place"))] == [("RAG", None), ("BERT", "Encoder model")]
    assert [r["target"] for r in rows(M.links(lines, M.IMAGE))] == ["Pasted image.png"]
    assert rows(M.code_blocks(lines))[0]["last_line"] == 13


def test_frontmatter(spark):
    texts = ["---\na: 1\n---\nx", "---\na: 1", "plain", "---\n- a\n- b\n---", "---\n...\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id long, note string")
    assert [r["status"] for r in rows(M.frontmatter(df).orderBy("note_id"))] == ["ok", "unclosed", "none", "not_a_mapping", "ok"]


def test_section_hierarchy(spark):
    text = "before\n\n# A\n\nx\n## B\n### C\ny\n### D\n## E\n#\nz"
    got = rows(M.sections(M.lines(note(spark, text))).orderBy("section_no"))
    assert [r["path"] for r in got] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "D"], ["A", "E"], ["__empty_heading__"]]
    assert [r["parent_line"] for r in got] == [None, None, 3, 6, 6, 3, None]
    assert [r["full_end_line"] for r in got][1:3] == [10, 9] and got[0]["body"] == "before"
    sib = {r["start_line"]: (r["previous_line"], r["next_line"]) for r in rows(M.siblings(M.sections(M.lines(note(spark, text)))))}
    assert sib[6] == (None, 10) and sib[7] == (None, 9) and sib[3] == (None, 11)


def test_line_blocks_and_paragraphs(spark):
    text = "# H\n\npara one\nmore\n\n- a\n- b\n12. c\n1. not a list\n| t |\n\n> q"
    lines = M.lines(note(spark, text))
    assert sorted(r["kind"] for r in rows(M.line_blocks(lines))) == ["heading", "list", "list", "list", "paragraph", "paragraph", "paragraph", "table"]
    blocks = rows(M.paragraphs(M.sections(lines)).orderBy("block_no"))
    assert [b["list_item_count"] for b in blocks] == [0, 4, 0] and blocks[2]["blockquote_line_count"] == 1


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, k, i) for i, k in enumerate("AXB", 1)] + [(2, k, i) for i, k in enumerate("XYA", 1)], "query_id long, key string, rank int")
    gold = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "query_id long, key string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r["query_id"]: r for r in rows(X.questions(ranked, gold, asked, 5))}
    a = got[1]
    assert (a["precision"], a["recall"], a["mrr"], a["r_precision"]) == (0.4, 1.0, 1.0, 0.5)
    assert abs(a["f1"] - 4 / 7) < 1e-5 and abs(a["map"] - 5 / 6) < 1e-5 and abs(a["ndcg"] - 1.5 / (1 + 1 / math.log2(3))) < 1e-5
    assert got[2]["ndcg"] == 0.5 and abs(got[2]["mrr"] - 1 / 3) < 1e-5 and got[3]["reason"] == "empty_gold"
    two = {r["query_id"]: r for r in rows(X.questions(ranked, gold, asked, 2))}
    assert two[2]["recall"] == 0.0
    assert rows(X.macro(X.questions(ranked, gold, asked, 5)))[0]["scored_count"] == 2


def test_fusion_and_rerank(spark):
    dense = spark.createDataFrame([(1, 7, 1, 0.9), (1, 8, 2, 0.8)], "query_id long, chunk_id long, rank int, score double")
    lexical = spark.createDataFrame([(1, 7, 1, 3.0)], "query_id long, chunk_id long, rank int, score double")
    got = rows(R.fuse(dense, lexical).orderBy("rank"))
    assert [r["chunk_id"] for r in got] == [7, 8] and (got[0]["score_1"], got[0]["score_2"]) == (0.9, 3.0) and got[1]["score_2"] is None
    assert [r["chunk_id"] for r in rows(R.rerank(dense, 1, -F.col("score")))] == [8]
    with pytest.raises(TypeError):
        R.payload_filter(dense, {"chunk_id": [1]})


@pytest.mark.parametrize("parts", [1, 5])
def test_dense_search_does_not_depend_on_partitions(spark, parts):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(100)], "chunk_id long, vector array<double>").repartition(parts)
    q = v.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in rows(R.dense(q, v, 2))}
    assert all(got[(i, 1)] == i for i in range(3)) and len(got) == 6


def test_pack_and_gate(spark):
    df = spark.createDataFrame([(1, 1, "a" * 400), (1, 2, "b"), (2, 1, "c" * 20), (2, 2, "d" * 40), (2, 3, "e")], "query_id long, rank int, text string")
    got = rows(S.pack(df, 10))
    assert [(r["query_id"], r["rank"]) for r in got] == [(1, 1), (2, 1)] and all(r["tokens"] <= 10 for r in got)
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    hits = spark.createDataFrame([(1, 0.9), (2, 0.1)], "query_id long, score double")
    assert [r["refusal"] for r in rows(S.gate(asked, hits, 0.5).orderBy("query_id"))] == [None, "retrieved context is below the score threshold", "no retrieved context"]
    assert rows(spark.range(1).select(estimated_tokens(F.lit("x" * 41)).alias("n")))[0]["n"] == 11


def test_answers(spark):
    replies = ['```json\n{"answer":"a","citations":[{"chunk_id":1},{"chunk_id":1},{"chunk_id":9}],"confidence":2}\n```', 'Sure {"answer": "x \\approx y", "confidence": 0.5} bye', "none", '{"answer": ""}', '{"answer": "a", "confidence": true}']
    df = spark.createDataFrame([(i, r, [1]) for i, r in enumerate(replies)], "query_id long, reply string, allowed array<long>").withColumn("note_paths", F.create_map(F.lit(1).cast("long"), F.lit("a.md")))
    got = rows(S.parse_answers(df).orderBy("query_id"))
    assert (got[0]["answer"], got[0]["citations"], got[0]["confidence"]) == ("a", [{"chunk_id": 1, "note_path": "a.md"}], 1.0) and got[1]["answer"] == "x \\approx y"
    assert [g["error"] for g in got[2:]] == ["unreadable reply", "reply without a usable answer", "reply without a usable confidence"]


def test_cache_eviction_and_versions(spark):
    e = spark.createDataFrame([("v", 1, 10), ("v", 2, 20), ("w", 3, 5)], "version string, entry_id long, last_used long")
    new = spark.createDataFrame([("v", 4, 30)], "version string, entry_id long, last_used long")
    assert sorted(r["entry_id"] for r in rows(S.cache_store(e, new, 2))) == [2, 3, 4]


def test_decisions(spark):
    new = spark.createDataFrame([("a", "h1", "parsed", "p"), ("b", "h", "parsed", "p"), ("c", "h", "failed", "p"), ("d", "h", "parsed", "p2"), ("e", "h", "parsed", "p")], "relative_path string, content_hash string, parse_status string, parser_version string")
    old = spark.createDataFrame([("a", "h0", "p", "new"), ("b", "h", "p", "stale"), ("d", "h", "p", "new"), ("e", "h", "p", "failed"), ("z", "h", "p", "new")], "relative_path string, content_hash string, parser_version string, last_status string")
    got = {r["relative_path"]: r["decision"] for r in rows(G.decide(new, old))}
    assert got == {"a": "changed", "b": "unchanged", "c": "failed", "d": "changed", "e": "changed"}
    assert [r["relative_path"] for r in rows(G.stale(new, old))] == ["z"]
    assert rows(G.counters(G.decide(new, old), G.stale(new, old)))[0]["status"] == "partial"


def test_index_versions(spark):
    old = spark.createDataFrame([(1, "p", None)], "id long, parser string, chunking string")
    wanted = spark.createDataFrame([("p", None), ("q", None)], "parser string, chunking string")
    assert sorted((r["parser"], r["id"]) for r in rows(G.get_or_create(old, wanted, ["parser", "chunking"], "id"))) == [("p", 1), ("q", 2)]


def test_links(spark):
    notes = spark.createDataFrame([(1, "d/target.md", "target"), (2, "e/other.md", "other"), (3, "f/other.md", "other")], "note_id long, relative_path string, title string")
    links = spark.createDataFrame([(9, "D/Target#Section"), (9, "target"), (9, "other"), (9, "Missing note")], "note_id long, target string")
    got = {r["target"]: r["target_note_id"] for r in rows(G.resolve_links(links, notes))}
    assert got == {"D/Target#Section": 1, "target": 1, "other": None, "Missing note": None}


def test_splitter():
    assert C.split("one two three", 10, 0) == ["one two three"]
    text = " ".join(f"w{i}" for i in range(40))
    got = C.split(text, 12, 3)
    assert len(got) > 3 and all(C.count_tokens(x) <= 12 for x in got) and got == C.split(text, 12, 3)
    assert all(a.split()[-1] in b.split()[:4] for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        C.Policy(10, 10)


def test_chunks(spark):
    text = "# Retrieval\n\n" + " ".join(f"word{i}" for i in range(60)) + "\n\n```python\nx = 1\ny = 2\n```\n\ntail"
    got = rows(C.chunks(note(spark, text), C.Policy(20, 3)).orderBy("chunk_index"))
    assert len(got) > 2 and all(r["text"].startswith("# Retrieval") for r in got) and any("```python\nx = 1\ny = 2\n```" in r["text"] for r in got)
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and all(0 <= r["start_offset"] <= r["end_offset"] <= len(text) for r in got)
    assert C.invalid(C.chunks(note(spark, text))).count() == 0


def test_chunks_keep_blocks_whole_and_know_their_places(spark):
    code = "```python\nresult = model.encode(text)\nprint(result)\n```"
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    text = f"lead in\n\n# Python\n\nIntroductory explanation before the example.\n\n{code}\n\nClosing explanation after the example.\n\n- one item of a list\n- other item\n\n{table}\n\n## Empty\n## Тест\n\n" + "слово " * 40
    got = rows(C.chunks(note(spark, text), C.Policy(30, 0)).orderBy("chunk_index"))
    assert any(code in r["text"] for r in got) and any(table in r["text"] for r in got) and any(r["text"] == "## Empty" for r in got)
    for r in got:
        span = text[r["start_offset"] : r["end_offset"]]
        assert span == span.strip() and (r["text"] == span or r["text"].endswith(span)) and r["source_length"] == len(text)
    last = [r for r in got if r["section_title"] == "Тест"]
    assert len(last) > 1 and last[0]["text"] == "## Тест" and all(r["text"].startswith("## Тест\n\n") for r in last[1:])
    assert max(len(C._TOKEN.findall(text[r["start_offset"] : r["end_offset"]])) for r in got) <= 30
    cut = rows(C.chunks(note(spark, text), C.Policy(12, 4)).orderBy("chunk_index"))
    assert not any(code in r["text"] for r in cut) and len(cut) > len(got)
    assert C.split("one two three four five six seven", 3, 1) == ["one two three", "three four five", "five six seven"] and C.split("abcdef", 3, 0) == ["abcdef"] and C.split("", 3, 0) == []


def test_policies_compared(spark):
    notes = note(spark, "# A\n\n" + "word " * 100 + "\n\n# B\n\nshort")
    got = {r["policy"]: r for r in rows(C.experiment(notes, {"small": C.Policy(20, 5), "large": C.Policy(500, 5)}))}
    assert got["large"]["chunks_total"] == 2 and got["large"]["oversized_sections_total"] == 0 and got["large"]["overlap_enabled"] == 0
    assert got["small"]["chunks_total"] > 5 and got["small"]["oversized_sections_total"] == 1 and got["small"]["overlap_enabled"] == 1 and got["small"]["metadata_completeness"] == 1.0
    assert all(r["boundary_violation_count"] == 0 and r["duplicate_hash_count"] in (0, got["small"]["duplicate_hash_count"]) for r in got.values())


def test_stored_generations(spark, tmp_path):
    stored = spark.createDataFrame([(1, "v1", 0), (1, "v1", 1), (1, "v2", 0), (2, "v1", 0)], "note_id long, chunking_version string, chunk_index int")
    assert rows(C.count_by_version(stored, "v1")) == [{"chunks": 3}]
    assert [r["chunk_index"] for r in rows(C.generation(stored, "v1", 1))] == [0, 1]
    left = rows(C.delete_generations(stored, spark.createDataFrame([(1, "v1")], "note_id long, chunking_version string")))
    assert sorted((r["note_id"], r["chunking_version"]) for r in left) == [(1, "v2"), (2, "v1")]
    with pytest.raises(ValueError):
        C.count_by_version(stored, " ")
    made = C.materialise(note(spark, "# A\n\ntext"), str(tmp_path / "chunks"), C.Policy(50, 0), "v3")
    assert [r["chunking_version"] for r in rows(made)] == ["v3"]


def test_headings_by_view(spark):
    text = "before it\n# One\na b c\n## Two\nd e\n# Three\n\n### Deep\nf"
    got = {(r["view"], r["level"]): (r["sections"], r["mean_words"], r["median_words"]) for r in rows(M.heading_statistics(M.sections(M.lines(note(spark, text)))))}
    assert got[("direct_body", None)] == (1, 2.0, 2.0) and got[("direct_body", 1)] == (2, 1.5, 1.5) and got[("full_span", 1)] == (2, 5.0, 5.0)
    assert got[("full_span", 2)] == (1, 3.0, 3.0) and got[("full_span", 3)] == (1, 2.0, 2.0)


def test_ingestion_run(spark):
    found = spark.createDataFrame([("a/new.md", "a", "new", "h1", "parsed", "p", None, None), ("a/same.md", "a", "same", "h2", "parsed", "p", None, None), ("a/bad.md", "a", "bad", "h3", "failed", "p", "ValueError", "no"), ("a/broken.md", "a", "broken", "h4", "failed", "p", "OSError", "gone")], "relative_path string, source_directory string, title string, content_hash string, parse_status string, parser_version string, error_type string, error_message string")
    stored = spark.createDataFrame([(1, "a/same.md", "a", "same", "h2", "parsed", "p", "unchanged"), (2, "a/broken.md", "a", "broken", "old", "parsed", "p", "new"), (3, "b/gone.md", "b", "gone", "h", "parsed", "p", "new")], "note_id long, relative_path string, source_directory string, title string, content_hash string, parse_status string, parser_version string, last_status string")
    links = spark.createDataFrame([("a/new.md", "same", None, 1, 0), ("a/bad.md", "same", None, 1, 0)], "relative_path string, target string, alias string, line int, place int")
    out = G.run(found, stored, links, 4, "a,b")
    notes = {r["relative_path"]: (r["note_id"], r["content_hash"], r["parse_status"]) for r in rows(out["notes"])}
    assert notes["a/same.md"] == (1, "h2", "parsed") and notes["a/broken.md"] == (2, "old", "parsed") and notes["b/gone.md"][0] == 3
    assert notes["a/bad.md"][1:] == ("h3", "failed") and notes["a/new.md"][1:] == ("h1", "parsed") and notes["a/new.md"][0] != notes["a/bad.md"][0]
    states = {r["relative_path"]: (r["status"], r["error_message"]) for r in rows(out["states"])}
    assert states == {"a/new.md": ("new", None), "a/same.md": ("unchanged", None), "a/bad.md": ("failed", "no"), "a/broken.md": ("failed", "gone"), "b/gone.md": ("stale", None)}
    assert [r["target_note_id"] for r in rows(out["links"])] == [1] and rows(out["run"])[0]["status"] == "partial"
    assert {r["relative_path"] for r in rows(G.run(found, stored, links, 5, "a", ["a"])["states"])} == set(states) - {"b/gone.md"}


def test_search_dispatch_and_filters(spark):
    asked = []
    hits = lambda name: lambda k: asked.append((name, k)) or spark.createDataFrame([(1, i, i + 1, 1.0 / (i + 1)) for i in range(k)], "query_id long, chunk_id long, rank int, score double")
    assert R.search("dense", 3, hits("d"), hits("l")).count() == 3 and R.search("hybrid", 30, hits("d"), hits("l")).count() == 30
    assert asked == [("d", 3), ("d", 30), ("l", 30)]
    with pytest.raises(ValueError):
        R.search("other", 1, hits("d"), hits("l"))
    assert R.query_filters({"lang": "ru"}, note_id=3, version="v1") == {"lang": "ru", "note_id": 3} and R.query_filters({}, "p", version="v1", lexical=True) == {"source_path": "p", "chunking_version": "v1"}
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6), (2, 1, None), (2, 2, 7)], "query_id long, rank int, note_id long")
    assert [(r["note_id"], r["rank"]) for r in rows(R.collapse(ranked).orderBy("rank"))] == [(5, 1), (6, 2)] and [r["query_id"] for r in rows(R.without_note(ranked))] == [2]


def test_embedding(spark):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "chunk_id long, text string").coalesce(1)
    good = E.embed(chunks, E.hashing_model(16), 16, batch=4)
    whole = rows(E.batch_result(E.embed(chunks.coalesce(1), E.hashing_model(16), 16, batch=4)))[0]
    assert whole["seconds"] > 0 and whole["vectors_per_second"] > 0 and {k: v for k, v in whole.items() if "second" not in k} == {"chunks": 10, "embedded": 10, "failed": 0, "retried": 0, "batches": 3, "batches_succeeded": 3, "batches_failed": 0, "attempts": 3, "failure_rate": 0.0}
    assert rows(E.batch_result(good.limit(0)))[0]["vectors_per_second"] == 0.0

    def broken(texts):
        raise OSError("down")

    bad = E.embed(chunks, broken, 16, retries=1)
    assert rows(E.batch_result(bad))[0]["failed"] == 10 and rows(bad)[0]["attempts"] == 2
    assert E.validity(good.where("status = 'ok'"), 16).where("NOT valid").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "vault" / "A" / "sub").mkdir(parents=True)
    (tmp_path / "vault" / "A" / "one.md").write_bytes("x\r\ny".encode())
    (tmp_path / "vault" / "A" / "sub" / "two.md").write_text("z")
    (tmp_path / "vault" / "A" / "no.txt").write_text("z")
    got = {r["relative_path"]: r["note"] for r in rows(N.notes(spark, str(tmp_path / "vault"), ["A"]))}
    assert got == {"A/one.md": "x\ny", "A/sub/two.md": "z"}
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            N.check_directory(bad)
    item = {"id": "q1", "question": "what", "source_directory": "a", "relevant_notes": ["a\\b.md"]}
    assert rows(evaluation.gold(spark, {"dataset_version": "v", "corpus_scope": "s", "items": [item]}))[0]["paths"] == ["a/b.md"]
    with pytest.raises(ValueError):
        evaluation.check_gold({"dataset_version": "v", "corpus_scope": "s", "items": [item, item]})
    with pytest.raises(ValueError):
        evaluation.check_paraphrases({"groups": [{"id": "g", "canonical": " "}]})


GOLD = """# authored by hand
dataset_version: set_v0
label_granularity: note
corpus_scope: A+B
relevant_chunk_ids: []
items:
  - id: q001
    question: "What is it?"
    source_directory: A
    relevant_notes:
      - A/One.md
      - A/Two.md
  - id: q002
    question: "And why?"
    source_directory: B
    relevant_notes: ["B\\\\Three.md", A/One.md, A/One.md]
"""


def test_gold_files_in_their_own_form(spark, tmp_path):
    from marginalia.sources import settings

    pytest.importorskip("yaml")
    (tmp_path / "gold.yaml").write_text(GOLD)
    items = evaluation.gold(spark, settings.read_mapping(str(tmp_path / "gold.yaml")))
    got = [r.asDict() for r in items.orderBy("item_id").collect()]
    assert [r["paths"] for r in got] == [["A/One.md", "A/Two.md"], ["B/Three.md", "A/One.md", "A/One.md"]] and {r["dataset_version"] for r in got} == {"set_v0"} and [r["source_directory"] for r in got] == ["A", "B"]
    index = spark.createDataFrame([("A/One.md", 7), ("A/Two.md", 3), ("B/Three.md", 9)], "path string, note_id long")
    folder = str(tmp_path / "items")
    for _ in range(2):  # a second load replaces the first
        evaluation.replace_evaluation(items, index, folder)
    stored = rows(evaluation.load_evaluation(spark, folder, "set_v0"))
    assert [(r["eval_item_id"], r["question"], r["relevant_note_ids"]) for r in stored] == [(1, "What is it?", [7, 3]), (2, "And why?", [9, 7])]
    assert evaluation.load_evaluation(spark, folder, "other").count() == 0
    with pytest.raises(ValueError, match="B/Three.md"):
        evaluation.replace_evaluation(items, index.where("note_id < 9"), folder)
    evaluation.replace_evaluation(items, index.withColumn("note_id", F.col("note_id") - 3), folder)
    for version in ("set_v0", " "):
        with pytest.raises(ValueError):
            evaluation.load_evaluation(spark, folder, version)
    for wrong in ({"relevant_notes": []}, {"relevant_notes": [" "]}, {"relevant_notes": "A/One.md"}, {"source_directory": " "}, {"question": None}):
        item = {"id": "q", "question": "what", "source_directory": "A", "relevant_notes": ["a.md"]} | wrong
        with pytest.raises(ValueError):
            evaluation.check_gold({"dataset_version": "v", "corpus_scope": "s", "items": [item]})
    group = {"id": "g", "canonical": "c", "paraphrases": [" a ", "b"]}
    assert evaluation.check_paraphrases({"dataset_version": "v", "groups": [group]}) == [("v", "g", "c", ["a", "b"])]
    for wrong in ({"groups": [group]}, {"dataset_version": "v", "groups": [group, group]}, {"dataset_version": "v", "groups": [group | {"paraphrases": [""]}]}):
        with pytest.raises(ValueError):
            evaluation.check_paraphrases(wrong)


def test_streams(spark):
    folder, work = new_folder(spark, "in"), new_folder(spark, "work")
    spark.createDataFrame([("v", "q", 0, "a"), ("v", "q", 500, "b"), ("v", "q", 5000, "c"), ("v", "r", 1, "d")], "version string, query string, at long, answer string").coalesce(1).write.parquet(folder)
    out, served = new_folder(spark, "out"), spark.readStream.schema("version string, query string, at long, answer string").parquet(folder)
    SI.drain(cache.serve(served, 1000, forget=False), work, lambda b, i: b.write.mode("append").parquet(out))
    got = {(r["query"], r["at"]): (r["hit"], r["answer"]) for r in rows(spark.read.parquet(out))}
    assert got == {("q", 0): (False, "a"), ("q", 500): (True, "a"), ("q", 5000): (False, "c"), ("r", 1): (False, "d")}
    schema, work = "version string, query string, at long, answer string", new_folder(spark, "work")
    table = lambda: {(r["version"], r["query"]): (r["at"], r["answer"]) for r in rows(SI.ingest(spark.readStream.schema(schema).parquet(folder), work, ["version", "query"], "at"))}
    first = {("v", "q"): (5000, "c"), ("v", "r"): (1, "d")}
    assert table() == first and table() == first  # the second run finds nothing new
    spark.createDataFrame([("v", "q", 7, "e"), ("w", "q", 9, "f")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert table() == first | {("v", "q"): (7, "e"), ("w", "q"): (9, "f")}
    SI.compact(spark, work, ["version", "query"], spark.read.parquet(folder).schema, new_folder(spark, "compact"))
    assert SI.current(spark, new_folder(spark, "none"), ["version"], spark.read.parquet(folder).schema).count() == 0
    day = logs.windows(spark.createDataFrame([(1, "x", 2.0), (2, "x", 4.0)], "n int, event_type string, value double").withColumn("ts", F.timestamp_seconds("n")))
    assert rows(day)[0]["mean_latency"] == 3.0


def test_r_precision_reads_ranks_up_to_the_gold(spark, tmp_path):
    from marginalia.plans import metrics as queries

    vectors = [(i, [1.0 + (i % 7)] + [0.0] * 63, 3) for i in range(600)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["query_id"]: r["r_precision"] for r in queries.metrics_rprecision(spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 200: 1.0, 400: 1.0}
    assert queries.metrics_macro(spark, str(tmp_path)).first()["r_precision"] == 1.0


def test_settings(tmp_path):
    import json

    from marginalia.sources import settings

    assert settings.policy({"name": " small ", "chunk_size": 64, "chunk_overlap": 8, "separators": ["\n", ""]}) == ("small", C.Policy(64, 8, ("\n", "")))
    for bad in ({"chunk_size": 3}, {"name": "x", "colour": 1}, {"name": "x", "chunk_size": True}, {"name": "x", "chunk_size": 4, "chunk_overlap": 4}):
        with pytest.raises(ValueError):
            settings.policy(bad)
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({"name": "file", "chunk_size": 10, "chunk_overlap": 0}))
    found, fraction = settings.protocol({"short_chunk_fraction": 0.5, "policies": [str(path), {"name": "own"}]})
    assert list(found) == ["file", "own"] and fraction == 0.5 and found["file"].chunk_size == 10
    for bad in ({"policies": []}, {"policies": [{"name": "a"}, {"name": "a"}]}, {"short_chunk_fraction": 1, "policies": [{"name": "a"}]}):
        with pytest.raises(ValueError):
            settings.protocol(bad)
    assert settings.sample_ids({"items": ["b", {"id": "a"}]}) == ["b", "a"]
    with pytest.raises(ValueError):
        settings.sample_ids({"items": ["a", "a"]})


def test_gold_that_is_not_bound(spark):
    items = spark.createDataFrame([("q1", "a.md"), ("q1", "b.md"), ("q2", "c.md")], "item_id string, path string")
    bound = evaluation.bind_gold(items, spark.createDataFrame([("a.md", 1)], "path string, note_id long"))
    assert evaluation.missing_paths(bound) == ["b.md", "c.md"]
    stored = rows(evaluation.evaluation_items(items.select("item_id").distinct(), spark.createDataFrame([("q1", "7")], "item_id string, stored_id string")).orderBy("item_id"))
    assert [r["stored_id"] for r in stored] == ["7", "eval-q2"]


def test_a_vault_that_is_not_there(spark, tmp_path):
    from marginalia.sources import notes as N

    with pytest.raises(ValueError):
        N.notes(spark, str(tmp_path / "none"), ["a"])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_bytes(b"# A\r\ntext")
    assert [(r["relative_path"], r["note"]) for r in rows(N.notes(spark, str(tmp_path), ["a"]))] == [("a/n.md", "# A\ntext")]


def test_settings_of_runs_and_the_manifest_of_a_matrix(spark, tmp_path):
    import json

    from marginalia.sources import notes as N

    for step in (1, 2):
        N.log_settings(spark, f"r{step}", "chunking", str(tmp_path / "runs"), {"size": 64 * step, "separators": ["\n"]}, {"scope": "all"})
    got = {(r["run_id"], r["role"], r["name"]): json.loads(r["value"]) for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert got[("r2", "param", "size")] == 128 and got[("r1", "param", "separators")] == ["\n"] and got[("r1", "tag", "scope")] == "all" and len(got) == 6
    policies, notes = {"small": C.Policy(16, 2), "large": C.Policy(64, 8)}, spark.createDataFrame([(1, "# A\n\n" + "word " * 100)], "note_id long, note string")
    N.write_matrix(C.experiment(notes, policies), policies, str(tmp_path / "matrix"))
    manifest = json.loads(spark.read.text(str(tmp_path / "matrix" / "manifest")).first()["value"])
    assert [(p["name"], p["chunk_size"]) for p in manifest["policies"]] == [("small", 16), ("large", 64)] and "chunks_total" in manifest["metrics"]
    config = json.loads(spark.read.text(str(tmp_path / "matrix" / manifest["policies"][1]["config"])).first()["value"])
    assert config["chunk_size"] == 64 and config["separators"] == list(C.SEPARATORS)
    assert {r["policy"]: r["chunks_total"] > 1 for r in spark.read.json(str(tmp_path / "matrix" / "json")).collect()} == {"small": True, "large": True}


@pytest.mark.parametrize("parts", [1, 3])
def test_dense_search_in_small_tiles_against_a_full_sort(spark, parts, monkeypatch):
    """Many ties, more places than a tile has vectors, vectors of another length and none."""
    monkeypatch.setattr(R, "TILE_QUERIES", 2)
    monkeypatch.setattr(R, "TILE_CHUNKS", 5)
    vectors = [(i, [float(i % 4), float(i % 3), 1.0]) for i in range(60)]
    v = spark.createDataFrame([*vectors, (100, [9.0, 9.0]), (101, None), (102, [])], "chunk_id long, vector array<float>").repartition(parts)
    q = v.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    for k in (1, 3, 9, 80):
        got = [(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in rows(R.dense(q, v, k).orderBy("query_id", "rank"))]
        want = []
        for i, x in vectors[:7]:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in vectors)[:k]
            want += [(i, j, -s, n) for n, (s, j) in enumerate(best, 1)]
        assert got == want


def test_a_task_of_dense_search_holds_no_scores_of_all_its_vectors():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    matrix, x = rng.normal(size=(2000, 8)), rng.normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.FixedSizeListArray.from_arrays(x.ravel(), 8).cast(pa.list_(pa.float64()))], names=["chunk_id", "vector"])
    tracemalloc.start()
    got = pa.Table.from_batches(R._nearest(np.arange(2000), matrix, 5, 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 10_000 and peak < 60 << 20  # all scores are 160 MB
    assert set(got.slice(0, 5)["chunk_id"].to_pylist()) == set(np.argsort(-(x @ matrix[0]))[:5].tolist())


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_relevant_within_a_depth_against_a_full_sort(spark, few):
    """Ties over many ids, ids below zero, rows without a label or a vector, depths from 0 to beyond all."""
    import random

    from marginalia.operators.depth import relevant_within

    rng = random.Random(4)
    made = [(i * 10_000_019 * (-1) ** i, [1.0, 2.0] if i % 2 else [round(rng.uniform(-2, 2), 3), rng.uniform(-1, 1)], None if i % 17 == 0 else i % 3) for i in range(400)]
    v = spark.createDataFrame([*made, (7, None, 1), (8, [1.0], 1)], "chunk_id long, vector array<double>, label int").repartition(3)
    asked = [(n, made[n][1], n % 3, depth) for n, depth in ((1, 0), (2, 1), (3, 57), (4, 133), (5, 133), (7, 250), (8, 400), (10, 999))]
    got = {r["query_id"]: r["found"] for r in relevant_within(spark.createDataFrame(asked, "query_id long, vector array<double>, label int, depth long"), v, few_rows=few).collect()}
    want = {}
    for n, q, label, depth in asked:
        order = sorted(made, key=lambda r: (-round(q[0] * r[1][0] + q[1] * r[1][1], 6), r[0]))
        want[n] = sum(r[2] == label for r in order[:depth])
    assert got == want


def test_metrics_from_judged_hits_agree_with_those_from_listed_gold(spark):
    import random

    rng = random.Random(6)
    ranked = spark.createDataFrame([(q, key, i) for q in range(6) for i, key in enumerate(rng.sample(range(40), 12), 1)], "query_id long, key long, rank int")
    gold = spark.createDataFrame([(q, key) for q in range(1, 8) for key in rng.sample(range(40), 1 + 4 * (q % 4))], "query_id long, key long")
    asked = spark.createDataFrame([(q,) for q in range(9)], "query_id long")
    sizes = gold.groupBy("query_id").agg(F.count("key").alias("n_gold"))
    judged = ranked.join(gold.withColumn("relevant", F.lit(True)), ["query_id", "key"], "left").na.fill(False, ["relevant"])
    within = judged.join(sizes, "query_id").groupBy("query_id").agg(F.count_if(F.col("relevant") & (F.col("rank") <= F.col("n_gold"))).alias("found"))
    for k in (1, 5):
        want = {r["query_id"]: r for r in rows(X.questions(ranked, gold, asked, k))}
        assert {r["query_id"]: r for r in rows(X.judged_questions(judged.where(F.col("rank") <= k), sizes, asked, k, within))} == want
        lists = {r["query_id"]: (len(r["hits"]), len(r["misses"]), sum(r["ranks"])) for r in rows(X.item_artifact(ranked, gold, k)) if r["query_id"] < 6}
        assert {r["query_id"]: (r["hits"], r["misses"], r["rank_sum"]) for r in rows(X.item_totals(judged, sizes, k))} == lists
    assert sorted(map(str, rows(X.judged_context(judged, sizes)))) == sorted(map(str, rows(X.context(ranked, gold))))


def test_bm25_top_agrees_with_all_scores(spark, monkeypatch):
    """Sums of one chunk at a time, of a few, of all; a query of unknown words, one without words, a chunk without words."""
    import random

    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30)))) for i in range(-20, 60)]
    chunks = spark.createDataFrame([*texts, (99, None)], "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a b c"), (2, "h h zz"), (3, "zz"), (4, ""), (5, "a b c d e f g h")], "query_id long, text string")
    index, n = R.postings(chunks), chunks.agg(F.count("*").alias("n"))
    for k in (1, 7, 200):
        want = sorted(map(str, rows(R.top_k(R.bm25(queries, index, n), k).select("query_id", "chunk_id", "score", "rank"))))
        for size in (8, 800, 1 << 20):
            monkeypatch.setattr(R, "SUMS_BYTES", size)
            assert sorted(map(str, rows(R.bm25_top(queries, index, n, k).select("query_id", "chunk_id", "score", "rank")))) == want
    monkeypatch.setattr(R, "BROADCAST_TERMS", 3)
    assert sorted(map(str, rows(R.bm25_top(queries, index, n, 200).select("query_id", "chunk_id", "score", "rank")))) == want
    assert R.bm25_top(queries.where("query_id = 3"), index, n, 5).count() == 0


def test_the_graph_retrieves_once_for_each_attempt(spark):
    counted = spark.sparkContext.accumulator(0)

    def retrieve(asked):
        def count(frames):
            for f in frames:
                counted.add(len(f))
                yield f

        return asked.select("query_id").mapInPandas(count, "query_id long").select("query_id", F.lit(1.0).alias("best"), F.lit("text").alias("context"))

    generate = lambda found: found.select("query_id", F.lit("made").alias("answer"), F.when(F.col("query_id") == 2, 0.1).otherwise(0.9).alias("confidence"), F.lit(1).alias("n_citations"))
    asked = spark.createDataFrame([(1, "what is this"), (2, "what is that")], "query_id long, query string")
    got = {r["query_id"]: r["retries"] for r in rows(S.answer_graph(asked, retrieve, generate))}
    assert got == {1: 0, 2: 1} and counted.value == 3


def test_search_methods_search_once_by_vectors_and_once_by_words(spark, monkeypatch):
    from marginalia.plans import registry, retrieval as queries

    asked = []
    for name in ("dense", "lexical"):
        monkeypatch.setattr(queries, name, lambda spark, sf_dir, k, name=name: asked.append((name, k)) or spark.createDataFrame([(1, i, 1.0 / (i + 1), i + 1) for i in range(k)], "query_id long, chunk_id long, score double, rank int"))
    got = rows(registry.QUERIES["search_methods"](spark, "none"))
    assert sorted(asked) == [("dense", 20), ("lexical", 20)] and len(got) == 20 and {r["method"] for r in got} == {"dense", "bm25", "hybrid"}
