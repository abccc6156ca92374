"""Ranked search against brute force, pruning, and small cases."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import lexical_search, queries

_R = random.Random(3)
WORDS = ["".join(_R.choice("abcdeé") for _ in range(_R.randint(1, 4))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(WORDS[min(int(r.expovariate(0.02)), 299)] for _ in range(n))


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k):
    split = [(i, Counter(cut(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in split:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(cut(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if lost else i, -s) for rank, (s, lost, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


DOCS = [(i, prose(random.Random(i).randint(1, 120), i)) for i in range(400)] + [(400 + i, prose(60, 7)) for i in range(40)] + [(3, prose(60, 7)), (None, prose(60, 7)), (500, None), (501, ""), (502, " .,;\n"), (503, prose(30_000, 8)), (504, "É é A-B a_b 漢字"), (505, WORDS[299].upper())]
ITEMS = [(i, prose(25, i)) for i in range(30)] + [(31, None), (32, ""), (33, "zzzz unknown"), (None, prose(20, 7)), (34, "a_b 漢字 É"), (5, prose(25, 5)), (35, WORDS[299])]


def answers(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    clash = {c: F.lit("x") for c in ("row", "n", "terms", "norm", "score", "rank", "query", "a.b")}
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumns(clash), spark.createDataFrame(DOCS, "doc_id long, text string").withColumns(clash).repartition(5)


@pytest.mark.parametrize("settings", [{}, {"k": 3, "rounds": (0.02, 1.0)}, {"k": 1000, "rounds": (1.0,)}, {"block_bytes": 600}])
def test_against_brute_force(tables, settings):
    got = lexical_search.search(*tables, **settings)
    assert answers(got) == brute(ITEMS, DOCS, settings.get("k", 10))
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["score"] == "bigint"


def test_empty_tables(spark, tables):
    items, docs = tables
    assert lexical_search.search(items.limit(0), docs).count() == 0
    assert lexical_search.search(items, docs.limit(0)).count() == 0
    assert lexical_search.search(items, docs.where("doc_id IN (500, 501, 502)")).count() == 0


def test_a_term_of_every_document_weighs_little_and_zero_is_not_returned(spark):
    docs = spark.createDataFrame([(i, "all") for i in range(5)], "doc_id long, text string")
    n = math.floor(1000 * math.log(12 / 11))
    got = answers(lexical_search.search(spark.createDataFrame([(1, "all all")], "item_id long, text string"), docs, 2))
    assert got == [(1, 1, 0, 2 * n * (1_000_000_000 // 1800)), (1, 2, 1, 2 * n * (1_000_000_000 // 1800))]


def test_bounds_prune_and_lose_nothing():
    """A bucket's survivors hold every document at or above the threshold, and few others."""
    rng = np.random.default_rng(1)
    block = lexical_search.Block([(0, 0, " ".join(f"t{i}" for i in range(12)))])
    block.vocabulary |= {f"u{i}": 12 + i for i in range(188)}
    block.weigh(100_000, {i: int(x) for i, x in enumerate(rng.integers(1, 40_000, 200))})
    table = np.where(rng.random((200, 3000)) < 0.05, rng.integers(1, 900_000, (200, 3000)), 0)
    norms = np.sqrt(((block.root[:, None] * table) ** 2).sum(0))
    score = block.gains[0] @ table[block.focus[0]]
    for least in (1, int(np.percentile(score, 50)), int(np.percentile(score, 99.5)), int(score.max())):
        found = lexical_search.survivors(block, 0, table, norms, least)
        assert set(np.flatnonzero(score >= least)) <= set(found)
    assert len(found) < 300


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = duck.sql("SELECT item_id, rank, doc_id, score FROM (" + queries.SQL["op12_lexical_search"] + ")").fetchall()
    assert answers(queries.op12_lexical_search(spark, sf)) == sorted(want, key=repr)
