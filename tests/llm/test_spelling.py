"""Spelling variants against brute force, the index against plain search, and small cases."""

import os
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginalia.llm import queries, spelling


def apart(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counted(docs, least_length, least, noise):
    total = Counter()
    for i, text in docs:
        for word, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{i}:{word}".encode())
            if noise and i is not None and h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least_length:
                total[word] += n
    return {w: n for w, n in total.items() if n >= least}


def brute(docs, least_length=6, least=5, ratio=5, noise=0):
    words = counted(docs, least_length, least, noise)
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, n_near = {}, {}
    for w, n in words.items():
        near = [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, ()) if apart(w, x)]
        n_near[w] = len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, n_near[w], form[w] and words[form[w]]) for w, n in words.items()), key=repr)


def answers(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def noisy(rng, letters, lengths, n):
    """Words that are edits of each other."""
    words = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n // 4)]
    while len(words) < n:
        w = list(rng.choice(words))
        i, what = rng.randrange(len(w)), rng.randrange(3)
        if what == 0:
            w[i] = rng.choice(letters)
        elif what == 1:
            w.insert(i, rng.choice(letters))
        elif len(w) > 2:
            del w[i]
        words.append("".join(w))
    return words


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("table", [spelling.TABLE, 64])
def test_index_finds_each_near_word_once(seed, table, monkeypatch):
    monkeypatch.setattr(spelling, "TABLE", table)
    rng = random.Random(seed)
    words = sorted(set(noisy(rng, "ab" if seed % 2 else "abcéÿ", range(2, 9), 150)))
    queries_ = sorted(set(noisy(rng, "abz", range(2, 9), 60)) | set(words[::2]))
    index, found = spelling.Index(words), []
    for second in (False, True):
        q, x = index.search(queries_, second)
        found += [(queries_[i], words[j]) for i, j in zip(q, x)]
    assert len(found) == len(set(found))
    assert set(found) == {(q, x) for q in queries_ for x in words if apart(q, x)}


def test_intervals_count_occurrences():
    words = sorted({"banana", "bandana", "ananas", "nab"})
    index, text = spelling.Index(words), "$" + "$".join(sorted({"banana", "bandana", "ananas", "nab"})) + "$"
    for pattern in ("a", "an", "ana", "nan", "$b", "b$", "$nab$", "x", "dana$"):
        for split in range(len(pattern)):
            at = index.start(1)
            codes = [0 if c == "$" else index.code.get(c, index.unknown) for c in pattern]
            for c in codes[split:]:
                at = index.grow(at, spelling.np.array([c]), spelling.RIGHT)
            for c in reversed(codes[:split]):
                at = index.grow(at, spelling.np.array([c]), spelling.LEFT)
            assert at[2][0] == len(re.findall(f"(?={re.escape(pattern)})", text)), (pattern, split)


def texts(seed, n_docs=60):
    rng = random.Random(seed)
    words = noisy(rng, "abcdeé", range(5, 9), 250) + ["A" * 40, "a" * 41, "×÷×÷×÷", "×÷×÷×÷×"]
    weights = [rng.choice((1, 1, 2, 8, 60)) for _ in words]
    return [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=200))) for i in range(n_docs)]


@pytest.fixture(scope="module")
def docs():
    return texts(1) + [(7, texts(1)[7][1]), (None, texts(2)[0][1]), (900, None), (901, ""), (902, "1 2 3 漢字 _"), (903, "é" * 3000 + " " + "ÿ" * 3000)] + [(910 + i, "w" * 2500 + " " + "w" * 2499 + " short") for i in range(5)]


@pytest.mark.parametrize("settings", [{}, {"noise": 3}, {"least_length": 2, "least": 1, "ratio": 2}])
@pytest.mark.parametrize("limit", [8192, 40])
def test_variants_against_brute_force(spark, docs, settings, limit):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "half", "part", "shard", "asks", "best", "a.b")}).repartition(4)
    got, want = answers(spelling.variants(df, limit=limit, **settings)), brute(docs, **settings)
    assert got == want and any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got) == any(r[1] and r[2] != r[1] for r in want)


def test_chains_end_at_the_root(spark):
    n = {"abcdefgh": 1000, "abcdefg": 200, "abcdef": 40, "abcdex": 8, "bcdefghi": 3}
    df = spark.createDataFrame([(i, f"{w} ") for w, k in n.items() for i in range(k)], "doc_id long, text string")
    got = {r[0]: r[1:3] for r in answers(spelling.variants(df, least=2))}
    assert got == {"abcdefgh": (None, "abcdefgh"), "abcdefg": ("abcdefgh", "abcdefgh"), "abcdef": ("abcdefg", "abcdefgh"), "abcdex": ("abcdef", "abcdefgh"), "bcdefghi": (None, "bcdefghi")}


def test_empty_table_and_bad_settings(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    for wrong in ({"least_length": 1}, {"ratio": 1}):
        with pytest.raises(ValueError):
            spelling.variants(empty, **wrong)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert answers(queries.op13_spelling(spark, sf)) == brute([(r["doc_id"], r["text"]) for r in rows], noise=199)
