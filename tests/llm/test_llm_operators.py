"""Small cases of every operator: nulls, empty and long texts, ties and repeats, empty tables, clashing columns; brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, exact_dedup, html_text, language_id, license_scan, mixing, near_dedup, sharding, token_store, toxicity

CLASH = ["__id", "__mark", "__row", "__n", "__copies", "__copy", "__keep_id", "__shard", "__hash", "row", "doc", "cell", "depth", "mark", "id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, rank long, salt int, size long, key string, bucket long, label string, n long, shard string, rep long, part int, `range` string"
_RNG = random.Random(5)
WORDS = ["".join(_RNG.choice("abcdefghij") for _ in range(_RNG.randint(3, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "x", 1, 2, 3, "k", 4, "l", 5, "s", 6, 7, "r")


LONG = prose(30_000, 99)
HARD = [row(1, None), row(2, ""), row(3, " \n\t"), row(4, LONG), row(5, LONG), row(6, prose(60, 1)), row(6, prose(60, 1)), row(7, prose(60, 1).upper(), None, None), row(8, "one two"), row(9, "one  two ", "fr", "b"), row(None, "one two"), row(10, "***", "de", "b"), row(11, "x" * 200_000), row(12, "é Ñ ß 漢字", "es", "c")]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(40, 7)), (2, None), (3, ""), (None, prose(30, 8)), (4, "alpha beta gamma"), (5, prose(40, 7))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 13)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# exact deduplication


def test_exact_dedup_against_brute_force(hard):
    got = rows(exact_dedup.annotate(hard))
    assert len(got) == len(HARD)
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in HARD:
        groups.setdefault(bare(r[1]), []).append((-len(r[1] or ""), r[0] if r[0] is not None else 1 << 62, r[0]))
    want = sorted((r[0] or -1, min(groups[bare(r[1])])[2] or -1, len(groups[bare(r[1])])) for r in HARD)
    assert sorted((g["doc_id"] or -1, g["keep_id"] or -1, g["group_size"]) for g in got) == want
    assert all(g["kept"] == (g["doc_id"] == g["keep_id"]) for g in got)


def test_exact_dedup_keep_returns_one_row_per_text_and_id(hard, empty):
    kept = rows(exact_dedup.keep(hard))
    texts = [re.sub(r"\s", "", r["text"] or "") for r in kept]
    assert len(texts) == len(set(texts)) and exact_dedup.keep(hard).columns == hard.columns
    assert exact_dedup.annotate(empty).count() == 0


def test_exact_dedup_keep_loses_no_text(spark):
    docs = [(None, "a b"), (None, "c"), (None, "ab"), (1, "d"), (1, "e"), (1, "d "), (2, "e"), (3, "f"), (3, "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    kept = exact_dedup.keep(df)
    assert sorted(((r["doc_id"], r["text"]) for r in rows(kept)), key=repr) == sorted([(None, "a b"), (None, "c"), (1, "d "), (1, "e"), (3, "f")], key=repr)
    assert kept.columns == df.columns


def test_exact_dedup_does_not_depend_on_salts(hard):
    assert sorted(map(str, rows(exact_dedup.annotate(hard, salts=1)))) == sorted(map(str, rows(exact_dedup.annotate(hard, salts=7))))


# near deduplication


def edit(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "changed" + str(r.randrange(1000))
    return " ".join(w)


def shingle_set(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_groups_against_brute_force(spark):
    docs, n = [], 0
    for g in range(12):
        base = prose(200, 100 + g)
        for c in range(6):
            docs.append((n, edit(base, c % 3, n)))
            n += 1
    docs += [(n + i, prose(120, 500 + i)) for i in range(40)]
    got = {r["doc_id"]: r["group_id"] for r in rows(near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")))}
    sets = {i: shingle_set(t) for i, t in docs}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j:
                s = len(a & b) / len(a | b)
                if s >= 0.82:
                    assert got[i] == got[j]
                elif s < 0.3:
                    assert got[i] != got[j]


def test_near_dedup_large_group_of_copies_with_outliers(spark):
    base = prose(60, 3)
    docs = [(i, edit(base, i % 7, i)) for i in range(300)]
    got = {r["doc_id"]: r["group_id"] for r in rows(near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")))}
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(got[i] == got[find(i)] for i in sets)


def test_near_dedup_links_of_a_bucket_are_fewer_than_its_labels(monkeypatch):
    base, least = prose(60, 3), 0.8
    docs = [(i, edit(base, i % 3, i)) for i in range(60)] + [(60 + i, prose(60, 900 + i)) for i in range(4)]
    docs = [{"rep": i, "label": i, "text": t} for i, t in docs]
    kind = pa.list_(pa.struct({"rep": pa.int64(), "label": pa.int64(), "text": pa.string()}))
    blocks = [docs[k::8] for k in range(8)]
    pairs = [(a, b) for i, a in enumerate(blocks) for b in blocks[i:]]
    batches = [pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[x : x + 5]], kind) for k in (0, 1)], ["docs_a", "docs_b"]) for x in range(0, len(pairs), 5)]

    class Even:
        class value:
            table = np.ones(near_dedup.CELLS)

    def found():
        return [(r["a"], r["b"]) for x in near_dedup._across(Even, least)(iter(batches)) for r in x.to_pylist()]

    def parts(links):
        label = list(range(len(docs)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    def similarity(a, b):
        x, y = shingle_set(a), shingle_set(b)
        return len(x & y) / len(x | y)

    every = [(x["rep"], y["rep"]) for x in docs for y in docs if x["rep"] < y["rep"] and similarity(x["text"], y["text"]) >= least]
    links = found()
    assert len(every) > 500 and parts(links) == parts(every)
    assert len(links) == len(docs) - len(parts(every))
    assert all(similarity(docs[a]["text"], docs[b]["text"]) >= least for a, b in links)
    monkeypatch.setattr(near_dedup.Joined, "MOST", 0)  # labels forgotten with each pair of blocks
    assert parts(found()) == parts(every)


def test_near_dedup_edge_cases(hard, empty):
    got = rows(near_dedup.groups(hard))
    assert len(got) == len(HARD)
    by = {g["doc_id"]: g for g in got}
    assert by[1]["group_id"] == 1 and by[2]["group_id"] == 2 and by[3]["kept"] and by[10]["kept"]
    assert by[5]["group_id"] == 4 and by[7]["group_id"] == 6 and by[9]["group_id"] == 8
    kept = rows(near_dedup.keep(hard))
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3, 4, 6, 8, 10, 11, 12]
    assert near_dedup.groups(empty).count() == 0 and near_dedup.keep(hard).columns == hard.columns


def test_near_dedup_keeps_different_texts_of_one_id_and_of_no_id(spark):
    near, a, b = prose(200, 61), prose(60, 62), prose(60, 63)
    docs = [(None, prose(60, 64)), (None, prose(60, 65)), (None, near), (None, prose(60, 65)), (5, a), (5, b), (5, a), (6, edit(b, 0, 1).upper()), (7, edit(near, 1, 2)), (8, edit(prose(200, 66), 1, 3)), (None, prose(200, 66)), (9, "***"), (9, "---"), (None, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in rows(near_dedup.keep(df))]
    want = [(None, prose(60, 64)), (None, prose(60, 65)), (5, a), (5, b), (7, edit(near, 1, 2)), (8, edit(prose(200, 66), 1, 3)), (9, "***"), (9, "---"), (None, ""), (None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    parts = {(g["group_id"], g["group_mark"]) for g in rows(near_dedup.groups(df)) if g["group_id"] == 5}
    assert len(parts) == 2


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses(spark):
    from marginalia.llm import words as wd

    morse = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    other = morse.translate({97: "b", 98: "a"})
    bodies = [morse + " " + prose(30, 1), other + " " + prose(30, 1), "z " * 40_000 + morse, "y" * 70_000 + " " + other]
    ((_, _, buf, offs),) = wd.text_slices(pa.array(bodies))
    h, _, _, first = wd.words(buf, offs)
    assert h[first[0]] == h[first[3] - 1] != h[first[1]] == h[first[4] - 1]
    got = rows(near_dedup.groups(spark.createDataFrame([(1, morse + " one"), (2, other + " one")], "doc_id long, text string")))
    assert sorted(g["group_id"] for g in got) == [1, 2]


def test_components_of_a_long_chain_a_hub_and_pairs(spark):
    from marginalia.llm.graph import components

    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(5000, 5001 + i) for i in range(2000)] + [(5000, 5000), (7000, 6000)]
    pairs = [(10_000 + 2 * i + 1, 10_000 + 2 * i) for i in range(50)] * 2
    got = {r["node"]: r["label"] for r in rows(components(spark.createDataFrame(chain + hub + pairs, "a long, b long").repartition(4)))}
    want = {i: 0 for i in range(301)} | {i: 5000 for i in range(5000, 7001)} | {10_000 + i: 10_000 + i // 2 * 2 for i in range(100)}
    assert got == want


def test_joins_that_spread_a_key(spark):
    from marginalia.llm.util import spread_join

    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0), (3, 0), (None, 1)], "k long, v long").repartition(3)
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k long, w string")
    for how in ("inner", "left"):
        assert sorted(map(repr, rows(spread_join(left, right, "k", "v", how)))) == sorted(map(repr, rows(left.join(right, "k", how))))


def test_weighted_sampling_agrees_with_weighted_similarity():
    rng = np.random.default_rng(0)
    s = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    w = rng.uniform(1, 4, 300)
    v = w * rng.uniform(0.5, 1.5, 300)
    sampler = near_dedup.Sampler(2000)
    a, b = (sampler(s, np.log(x).astype(np.float32), np.array([0]))[:, 0] for x in (w, v))
    assert abs((a == b).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


# token files


def test_token_files_round_trip(spark, hard, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.tokenizer_path())
    ordered = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for r in ordered:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(token_store.round_trip(hard))]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.round_trip(empty).count() == 0


def test_token_ids_are_those_of_the_library(spark):
    """Special tokens, punctuation, words that the library normalises, and words that a polynomial hash modulo 2**64 confuses."""
    from tokenizers import Tokenizer

    from marginalia.sources.storage import new_folder

    t = Tokenizer.from_file(token_store.tokenizer_path())
    morse = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    bodies = [morse, morse.translate({97: "b", 98: "a"}), "a <|endoftext|> b", "x<|endoftext|>y, <|STARTOFTEXT|>", "I'm, we'll; don't. A.B,C:d!e?f", "İstanbul e\u0301cole ﬁn ΑΣ x\u00a0y a\u200bb \x1c\x85", "1,000.5 a1.b2", "日本語、テスト。🙂", prose(300, 4).title()]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").coalesce(1)
    folder = new_folder(spark, "tokens")
    token_store.write(docs, folder)
    got = {r["doc_id"]: r["ids"] for r in rows(token_store.read_ids(spark, folder))}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in enumerate(bodies)}
    assert got[0] != got[1] and 49407 in got[2]


def test_words_are_known_without_the_punctuation_that_follows_them():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from marginalia.llm import words as wd

    path = token_store.tokenizer_path()
    encoder, t = token_store.Encoder(path), Tokenizer.from_file(path)
    bodies = [" ".join("stone" + x for x in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"), "don't stone's$ we'LL*", "x<|endoftext|>y) <|ENDOFTEXT|> e\u0301)) a<\u0338b k=\u0338 ''s|t"]
    (_, _, buf, offs), *_ = wd.text_slices(pa.array(bodies, pa.large_string()))
    ids, counts = encoder(buf, offs, 1)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in parts] == [t.encode(x, add_special_tokens=False).ids + [1] for x in bodies]
    assert [w for w in encoder.known if w.startswith(b"stone") and not w.startswith(b"stone'")] == [b"stone"]


def test_words_in_normal_form_are_not_normalised_again():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from marginalia.llm import words as wd

    path = token_store.tokenizer_path()
    encoder, t = token_store.Encoder(path), Tokenizer.from_file(path)
    bodies = ["", prose(400, 7).title(), "I'm, WE'LL; a1.b2 1,000.5 x\x1cy <tag>|", " \t\r\n", "".join(map(chr, range(128)))]
    encoder.tokenizer = None  # all is ASCII, so only the tokenizer without a normalizer is asked
    for most in (4, 1 << 20):
        got = []
        for _, _, buf, offs in wd.text_slices(pa.array(bodies), most):
            ids, counts = encoder(buf, offs, 1)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in bodies]


def test_token_ids_and_damage(spark):
    from marginalia.sources.storage import new_folder

    docs = spark.createDataFrame([(i, prose(50, i)) for i in range(40)], "doc_id long, text string")
    folder = new_folder(spark, "tokens")
    token_store.write(docs, folder)
    got = {r["doc_id"]: r["ids"] for r in rows(token_store.read_ids(spark, folder))}
    assert len(got) == 40 and all(x[-1] == 1 for x in got.values())
    data = bytearray(spark.read.parquet(folder).first()["data"])
    data[-40] ^= 255
    with pytest.raises(ValueError):
        token_store.unpack(bytes(data))


# decontamination


def test_decontamination(spark, items, hard, empty):
    leak, w = prose(40, 7), prose(40, 7).split()
    docs = spark.createDataFrame(
        [(1, prose(100, 21) + " " + leak + " " + prose(80, 22)), (2, prose(100, 23)), (3, leak.upper().replace(" ", ",\n")), (4, " ".join(w[:20] + ["other"] + w[21:])), (5, " ".join(w[:20])), (6, "see alpha, beta gamma."), (7, None), (8, "")], "doc_id long, text string"
    )
    got = {r["doc_id"]: r for r in rows(decontaminate.annotate(docs, items))}
    assert got[1]["item_ids"] == [1, 5] and got[1]["first_words"] == [100, 100] and got[1]["similarities"] == [1.0, 1.0]
    assert got[3]["item_ids"] == [1, 5] and got[4]["item_ids"] == [1, 5] and got[6]["item_ids"] == [4]
    assert not any(got[i]["contaminated"] for i in (2, 5, 7, 8))
    blocks = {r["doc_id"]: sorted(r["item_ids"]) for r in rows(decontaminate.annotate(docs, items, block_bytes=100))}
    assert blocks == {i: sorted(r["item_ids"]) for i, r in got.items()}
    for size in (8 << 20, 100):
        assert sorted(r["doc_id"] for r in rows(decontaminate.keep(docs, items, block_bytes=size))) == [2, 5, 7, 8]
    plan = decontaminate.annotate(docs, items, block_bytes=100)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # each block had a pass of its own
    assert decontaminate.annotate(hard, items).count() == len(HARD) and decontaminate.annotate(empty, items).count() == 0
    assert decontaminate.keep(docs, items.where("false")).count() == 8


def test_hamming_blocks_find_every_fingerprint_within_radius():
    rng = random.Random(1)
    items = decontaminate.Items(list(range(50)), [prose(30, 900 + i) for i in range(50)])
    for f in items.fingerprints.tolist():
        for d in (0, 5, decontaminate.RADIUS):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            want = [i for i, x in enumerate(items.fingerprints.tolist()) if bin(x ^ g).count("1") <= decontaminate.RADIUS]
            assert items.candidates(g).tolist() == want


def test_decontamination_search_against_all_windows(monkeypatch):
    import pyarrow as pa

    from marginalia.llm import words as wd

    r, instruction = random.Random(8), prose(24, 70)
    bodies = [instruction + " " + prose(36, 700 + i) for i in range(60)] + [prose(3, 71), prose(20, 72) + " " + prose(20, 72), prose(12, 73)]
    items = decontaminate.Items(list(range(len(bodies))), bodies)
    docs = [prose(30, 800 + i) + " " + prose(36, 700 + i) + " " + prose(40, 850 + i) for i in range(20)]  # the items without their instruction
    docs += [prose(36, 700 + i) + " " + instruction for i in range(20, 24)] + [" ".join(bodies[24].split()[30:] + bodies[24].split()[:30]) + " " + prose(9, 1)]
    docs += [edit(b, r.randint(0, 4), i) + " " + prose(20, i) for i, b in enumerate(bodies)] + [" ".join([instruction] * 5), prose(20, 72), ""]
    hashes = [wd.words(buf, offs)[0] for d in docs for _, _, buf, offs in wd.text_slices(pa.array([d], pa.large_string()))]
    want = []
    for h in hashes:
        sims = {i: max((items.similar(i, h[a : a + n]) for a in range(len(h))), default=0.0) for i, n in enumerate(items.n_words.tolist())}
        want.append({i: round(x, 9) for i, x in sims.items() if x >= items.similarity - 1e-9})
    assert sum(map(len, want)) > 60
    for pairs in (1 << 20, 10):
        monkeypatch.setattr(decontaminate, "_PAIRS", pairs)
        got = items.search(pa.array(docs, pa.large_string())).to_pylist()
        assert [dict(zip(g["item_ids"], (round(x, 9) for x in g["similarities"]))) for g in got] == want
    far = [bin(decontaminate.simhash(h[30:90]) ^ int(items.fingerprints[i])).count("1") for i, h in enumerate(hashes[:20])]
    assert max(far) > decontaminate.RADIUS and all(i in want[i] for i in range(20))


def test_decontamination_weighs_shingles_over_all_blocks(spark):
    shared = prose(20, 90)
    items = spark.createDataFrame([(i, shared + " " + prose(20, 900 + i)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(20, 900 + i)) for i in range(12)] + [(50, shared + " " + prose(20, 903))], "doc_id long, text string")
    one, many = (sorted((r["doc_id"], sorted(zip(r["item_ids"], [round(x, 9) for x in r["similarities"]]))) for r in rows(decontaminate.annotate(docs, items, block_bytes=b, similarity=0.5))) for b in (1 << 20, 600))
    assert one == many and sum(len(x) for _, x in one) == 13


# licenses


def test_license_places_against_brute_force(spark, hard, empty):
    texts = ["MIT License and mit license", "Licensed under the Apache License, Version 2.0", "GNU General Public License v3 or MIT", None, "", "mitlicense", "mit  license general public\nlicense", "SPDX-License-Identifier: BSD-3-Clause"]
    got = {r["doc_id"]: r for r in rows(license_scan.annotate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        g = got[i]
        assert (g["n_words"], g["n_base"], g["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (g["first_word"], g["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert got[1]["labels"] == "apache,apache-2.0" and got[7]["labels"] == "bsd-3-clause"
    assert license_scan.annotate(hard).count() == len(HARD) and license_scan.annotate(empty).count() == 0


def test_license_suppression_prefers_the_longer_signature():
    found = license_scan.detect("licensed under the gnu lesser general public license", {"general", "gnu", "lesser", "license"})
    assert [d.label for d in found] == ["lgpl"]
    assert len(license_scan.RULES) > 200


def sample(tokens, r):
    """A text that a parsed pattern matches."""
    out = ""
    for kind, value in tokens:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            k, v = r.choice(value)
            out += chr(v if str(k) == "LITERAL" else r.randint(*v))
        elif kind == "BRANCH":
            out += sample(r.choice(value[1]), r)
        elif kind == "SUBPATTERN":
            out += sample(value[-1], r)
        elif kind == "MAX_REPEAT":
            least, most, inner = value
            out += "".join(sample(inner, r) for _ in range(r.randint(least, min(int(most), least + 4))))
        else:
            assert kind == "ASSERT_NOT"
    return out


def test_license_suppression_against_brute_force():
    r = random.Random(8)
    for _ in range(60):
        found = []
        for k in range(r.randint(0, 40)):
            a = r.randint(0, 30)
            found.append(license_scan.Detection(a, a + r.randint(1, 12), "x", r.choice((40, 50, 70)), k % 7, 0.5))
        kept = []
        for d in sorted(found, key=lambda d: (-d.priority, d.order, d.first_word)):
            if not any(k.first_word <= d.first_word and d.end_word <= k.end_word for k in kept):
                kept.append(d)
        assert sorted(license_scan.unsuppressed(found)) == sorted(kept)


def test_license_rules_stand_in_texts_of_their_own_words():
    """Every phrase of a license body without alternatives is found in itself, under its label or under a wider one that holds it."""
    for label, keyword, pattern in license_scan.PHRASES:
        if not any(c in pattern for c in "(|[?"):
            assert keyword in pattern.split(), pattern
            assert label in {d.label for d in license_scan.detect("before " + pattern + " after", set(pattern.split()) | {"spdx", "license", "licenses"})} or any(pattern in p for _, _, p in license_scan.PHRASES if p != pattern), pattern
    assert len(license_scan.PHRASES) > 150


def test_license_keyword_gate_loses_nothing():
    from re import _parser

    import pyarrow as pa

    r, every = random.Random(6), {x.keyword for x in license_scan.RULES}
    for rule in license_scan.RULES:
        tree = _parser.parse(rule.pattern.pattern)
        for _ in range(12):
            text = " ".join(sample(tree, r).split())
            if not rule.pattern.search(text):  # a class of letters and spaces may have met a word
                continue
            assert rule.keyword in text.split(), (rule.keyword, text)
            assert license_scan.detect(text, every & set(text.split())) == license_scan.detect(text, every)
    cut = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "licensed under the SIL Open Font License, Version 1.1"]
    assert [x["labels"] for x in license_scan.scan(pa.array(cut, pa.large_string())).to_pylist()] == ["mit", "apache-2.0", "ofl-1.1"]


# language


def test_language_network_against_a_naive_form():
    rng = np.random.default_rng(4)
    widths, n = language_id.WIDTHS, language_id.FILTERS
    net = language_id.Network(["a", "b", "c"], [rng.normal(0, 1, (w, language_id.CLASSES, n)) for w in widths], rng.normal(0, 1, len(widths) * n).astype(np.float32), rng.normal(0, 1, (len(widths) * n, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    bodies = ["Hello, wörld 12", "x" * 256, prose(150, 2), "日本語 text"]
    ((_, _, buf, offs),) = language_id.wd.text_slices(pa.array(bodies))
    windows, doc, letters = language_id._windows(buf, offs)
    got = net.log_probabilities(windows)
    for x, row in zip(windows, got):
        peaks = []
        for w, filters in zip(widths, net.filters):
            for f in range(n):
                peaks.append(max(sum(filters[j][x[i + j]][f] for j in range(w)) for i in range(len(x) - w + 1)))
        z = np.maximum(np.array(peaks) + net.bias, 0) @ net.top + net.top_bias
        assert np.allclose(row, z - z.max() - np.log(np.exp(z - z.max()).sum()), atol=1e-3)
    plain = [t.encode() for t in bodies]
    assert doc.tolist() == [i for i, t in enumerate(plain) for _ in range(-(-len(t) // 256))] and letters.sum() == sum(sum(c >= 128 or chr(c).isalpha() for c in t) for t in plain)


def test_language_identification(spark, hard, empty):
    r = random.Random(2)
    alphabets = {"aa": "abcdef ", "bb": "uvwxyz ", "cc": "éèàùç "}
    docs = [(i, "".join(r.choice(alphabets[k]) for _ in range(r.randint(30, 900))), k) for i, k in enumerate(list(alphabets) * 60)]
    got = rows(language_id.annotate(spark.createDataFrame(docs, "doc_id long, text string, lang string")))
    by = {g["doc_id"]: g for g in got}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(by[i]["held_out"] for i in held) and sum(by[i]["lang_pred"] == docs[i][2] for i in held) >= 0.95 * len(held)
    edge = {r["doc_id"]: r for r in rows(language_id.annotate(hard))}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (1, 2, 3, 10)) and edge[12]["lang_pred"] != "und"
    assert language_id.annotate(empty).count() == 0
    assert {r["lang_pred"] for r in rows(language_id.annotate(hard.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


# toxicity


def test_toxicity_learns_words_and_pairs(spark, hard, labels, empty):
    r = random.Random(3)
    docs, marks = [], []
    for i in range(600):
        words, toxic = [r.choice(WORDS) for _ in range(60)], int(i % 4 == 0)
        if toxic:
            words[r.randrange(60)] = "insultword"
        docs.append((i, " ".join(words)))
        marks.append((i, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = rows(toxicity.annotate(docs, marks).join(marks, "doc_id"))
    held = [g for g in got if g["held_out"]]
    assert held and all(g["predicted"] == g["toxic"] for g in held) and all(0 <= g["score"] <= 1 for g in got)
    assert toxicity.keep(docs, marks).count() == 450
    assert toxicity.annotate(hard, labels).count() == len(HARD) and toxicity.annotate(empty, labels).count() == 0
    assert toxicity.annotate(hard, labels.where("false")).where("predicted = 1").count() == 0


def test_factorization_machine_learns_an_interaction():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    docs = [np.array([1] * x + [2] * y + [3 + int(k)], np.int64) for x, y, k in zip(a, b, rng.integers(0, 5, 2000))]
    m = toxicity.Machine.fit((a & b).astype(float), docs)
    at = {int(t): i for i, t in enumerate(m.terms)}

    def score(*terms):
        i = [at[t] for t in terms]
        v = m.factors[i]
        return m.bias + m.weights[i].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())

    assert score(1, 2) > 0 > max(score(1), score(2))


def test_terms_that_tell_only_in_pairs_are_learned(spark):
    """Label 1 where exactly one of two words stands: neither word alone tells anything. And texts that share a line are all learned from."""
    r = random.Random(12)
    docs, marks = [], []
    for i in range(1500):
        x, y = r.random() < 0.5, r.random() < 0.5
        words = [r.choice(WORDS) for _ in range(25)] + ["firstword"] * x + ["secondword"] * y
        r.shuffle(words)
        docs.append((i, "one line that stands in all of the texts of this corpus before others come " + " ".join(words)))
        marks.append((i, int(x != y)))
    docs, marks = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = rows(toxicity.annotate(docs, marks).join(marks, "doc_id"))
    held = [g for g in got if g["held_out"]]
    assert sum((g["score"] >= 0.5) == g["toxic"] for g in held) > 0.95 * len(held)
    again = rows(toxicity.annotate(docs.repartition(7), marks.repartition(2)))
    assert {g["doc_id"]: g["score"] for g in again} == {g["doc_id"]: g["score"] for g in got}


def test_pairs_below_many_more_frequent_terms_are_learned():
    """Label 1 where exactly one of two terms stands, among 2,000 more frequent ones and as many that stand where these do."""
    rng = np.random.default_rng(4)
    n, m = 2500, 2000
    a, b, often = rng.random(n) < 0.5, rng.random(n) < 0.5, rng.random((n, m)) < 0.6
    docs = [np.sort(np.concatenate((10 + np.flatnonzero(o), 10_000 + np.flatnonzero(o), [1] * int(x) + [2] * int(y)))).astype(np.int64) for o, x, y in zip(often, a, b)]
    machine = toxicity.Machine.fit((a ^ b).astype(float), docs)
    assert {1, 2} <= set(machine.terms.tolist())
    sets = [np.array([1, 3, 4]), np.array([2]), np.array([1, 2, 3])]
    assert sorted(toxicity._different(sets, np.array([1, 2, 3, 4]))) == [0, 1, 3]


def test_toxicity_scores_against_a_naive_form(spark):
    import math

    docs = spark.createDataFrame([(i, prose(30, i) + (" insult group" if i % 3 == 0 else " insult" if i % 3 == 1 else " group")) for i in range(300)], "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    machine = toxicity.fit(docs, marks)
    bodies = [r["text"] for r in docs.collect()] + ["", "Insult", "GROUP insult " + prose(4000, 3)]
    got = machine.score(pa.array(bodies))

    def term(word):
        parts = toxicity._terms(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        return {int(t) for ts, _ in parts for t in ts}

    known = {int(t): i for i, t in enumerate(machine.terms)}
    for text, score in zip(bodies, got):
        have = sorted({known[t] for w in text.lower().split() for t in term(w) if t in known})
        total = machine.bias + sum(machine.weights[i] for i in have)
        total += sum(float(machine.factors[i] @ machine.factors[j]) for i in have for j in have if i < j)
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, total))))) < 1e-9


# mixing


def test_mixing_against_brute_force(spark, empty):
    r = random.Random(4)
    docs = [(i, prose(r.randint(0, 80), i) if i % 9 else None, None if i % 5 == 0 else "src%d" % (i % 4)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("taken", F.lit(1)).repartition(5)
    got = rows(mixing.plan(df, range_rows=7))
    assert len(got) == 300 and sorted(map(str, got)) == sorted(map(str, rows(mixing.plan(df, range_rows=1000))))
    size = {i: len((t or "").split()) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    totals = {}
    for i, s in source.items():
        totals[s] = totals.get(s, 0) + size[i]
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * totals[s]}
        for s in full or open_:
            target[s] = 2.0 * totals[s] if s in full else level * weight[s]
            left -= target[s] if s in full else 0
        open_ = open_ - full if full else set()
    for s in order:
        own = [g for g in got if source[g["doc_id"]] == s]
        assert abs(sum(g["taken"] for g in own) - target[s]) <= 1 and all(abs(g["target"] - target[s]) < 1e-6 for g in own)
    assert all(g["size"] == size[g["doc_id"]] and g["taken"] <= 2 * g["size"] for g in got)
    mixed = mixing.mix(df)
    n = {x["source"]: x["n"] for x in rows(mixed.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1))).alias("n")))}
    assert mixed.columns == df.columns and all(abs(n[s] - target[s]) <= 80 for s in order)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_edge_cases(hard):
    got = rows(mixing.plan(hard))
    assert len(got) == len(HARD) and all(g["taken"] <= 2 * g["size"] for g in got)
    assert mixing.mix(hard).columns == hard.columns


def test_mixing_of_one_id_in_two_sources_and_of_crowded_ids(spark):
    """400 rows of 100 ids, each id in both sources with other texts; then one id, and no id, with a third of all rows each."""
    docs = [(i % 100, prose(5 + i % 37, i), "ab"[i % 200 // 100]) for i in range(400)]
    docs += [(7, prose(1 + i % 9, 1000 + i), "c") for i in range(300)] + [(None, "same text here", "c")] * 150 + [(None, prose(1 + i % 9, 2000 + i), None) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in CLASH})
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(t.split())
    plans = [sorted(map(repr, rows(mixing.plan(df.repartition(n), range_rows=k)))) for n, k in ((1, 10_000), (3, 4), (5, 30))]
    assert plans[0] == plans[1] == plans[2] and len(plans[0]) == len(docs)
    target = {r["source_size"]: r["target"] for r in rows(mixing.plan(df))}
    mixed = mixing.mix(df.repartition(3), range_rows=4)
    n = {r["source"]: 0 for r in rows(mixed)}
    for r in rows(mixed):
        n[r["source"]] += len(r["text"].split())
    assert mixed.columns == df.columns and all(abs(n[s] - target[size[s]]) <= 45 for s in size)


# sharding


@pytest.mark.parametrize("limit", [1, 500, 5_000, 1 << 30])
def test_shards_keep_their_limit(spark, hard, limit):
    docs = spark.createDataFrame([(i, prose(i % 50, i)) for i in range(400)], "doc_id long, text string")
    got = rows(sharding.assign(docs, limit))
    sums, counts = {}, {}
    for g in got:
        sums[g["shard"]] = sums.get(g["shard"], 0) + g["n_bytes"]
        counts[g["shard"]] = counts.get(g["shard"], 0) + 1
    assert len(got) == 400 and all(s <= limit or counts[k] == 1 for k, s in sums.items())
    assert all(g["shard_bytes"] == sums[g["shard"]] and g["shard_docs"] == counts[g["shard"]] for g in got)
    for g in got:  # only what did not fit has split: the parent bucket is too large
        if g["depth"]:
            depth, prefix = map(int, g["shard"].split("-"))
            parent = sum(s for k, s in sums.items() for d, p in [map(int, k.split("-"))] if d >= depth - 1 and p >> (d - depth + 1) == prefix >> 1)
            assert parent > limit
    assert sharding.assign(hard, limit).count() == len(HARD)


def test_sharding_of_one_repeated_id_and_of_nothing(spark, hard, empty):
    docs = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    got = rows(sharding.assign(docs, 1000))
    assert len(got) == 50 and all(g["shard_bytes"] <= 1000 for g in got)
    assert sharding.assign(empty).count() == 0
    out = sharding.shard(hard)
    assert out.columns == [*hard.columns, "shard_id"] and out.count() == len(HARD)


def test_shard_keeps_the_limit_for_rows_of_repeated_and_missing_ids(spark):
    docs = [(i // 2, "x" * 700) for i in range(40)] + [(None, "y" * (300 + i)) for i in range(30)] + [(99, "z" * 100)] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows(sharding.shard(df, 1000))
    sums = {}
    for g in got:
        sums.setdefault(g["shard"], []).append(len(g["text"]))
    assert sorted((str(g["doc_id"]), g["text"]) for g in got) == sorted((str(i), t) for i, t in docs)
    assert all(sum(x) <= 1000 or len(x) == 1 for x in sums.values())


def test_shard_moves_no_document_and_a_large_directory_gives_the_same_shards(spark, monkeypatch):
    docs = [(i // 2, "x" * (1 + i * 37 % 700)) for i in range(300)] + [(None, "y" * (300 + i)) for i in range(30)] + [(99, "z" * 100)] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(sharding, "STRIDE", 2)
    for limit in (1000, 1 << 30):
        out = sharding.shard(df, limit)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        got = sorted((r["shard"], r["text"]) for r in rows(out))
        with monkeypatch.context() as few:
            few.setattr(sharding, "SMALL", 0)
            large = sharding.shard(df, limit)
            assert sorted((r["shard"], r["text"]) for r in rows(large)) == got
        sums = {r["shard"]: (r["shard_bytes"], r["shard_docs"]) for r in rows(sharding.directory(df, limit))}
        for shard, (n_bytes, n_docs) in sums.items():
            texts = [t for s, t in got if s == shard]
            assert (sum(map(len, texts)), len(texts)) == (n_bytes, n_docs)
        assert {s for s, _ in got} == set(sums) and len(got) == len(docs)


def test_shards_are_written_and_the_directory_names_them(spark, monkeypatch):
    from marginalia.sources.storage import new_folder

    monkeypatch.setattr(sharding, "STRIDE", 3)
    docs = [(i, "x" * (1 + i * 7 % 90)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    folder = new_folder(spark, "shards")
    sharding.write(df, folder, 900)
    back = rows(spark.read.parquet(folder))
    sums = {}
    for r in back:
        n, k = sums.get(r["shard"], (0, 0))
        sums[r["shard"]] = n + len(r["text"]), k + 1
    assert sorted((r["doc_id"], r["text"]) for r in back) == docs and all(n <= 900 for n, _ in sums.values())
    leaves = rows(sharding.directory(df, 900))
    assert {r["shard"]: (r["shard_bytes"], r["shard_docs"]) for r in leaves} == sums
    for monkey in (1, 60):
        monkeypatch.setattr(sharding, "STRIDE", monkey)
        assert sorted(map(repr, rows(sharding.directory(df, 900)))) == sorted(map(repr, leaves))
    monkeypatch.setattr(sharding, "SMALL", 0)
    assert sorted(map(repr, rows(sharding.directory(df, 900)))) == sorted(map(repr, leaves))


# pages


def test_pages(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=1>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>First   para\ngraph with <a href=x>a link</a>.</p><p>Second<script>var a='</p>';</script> one"
        "<ul><li>item<li>other</ul><form><input>Search</form><aside>Side</aside><div id='comments'><p>Reader</p></div></article><div class='sidebar'>Links</div><footer>&copy; foot</footer>"
    )
    rows_in = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "just text"), (4, "w", "just text"), (None, "x", "<p>a<br>b"), (5, "y", "<" * 1000 + "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows_in, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = rows(html_text.annotate(df))
    assert len(got) == len(rows_in)
    by = {g["page_id"]: g for g in got}
    assert by[1]["text"] == "Title & more\nFirst para graph with a link.\nSecond one\nitem\nother" and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == "" and by[4]["text"] == "just text" and by[None]["text"] == "a\nb" and by[5]["text"].endswith("deep")
    assert html_text.annotate(df.where("false")).count() == 0


def test_density_finds_the_text_without_article_tags():
    page = "<body><div id=top>" + "<a href=x>link</a> " * 30 + "</div><div><div><p>" + prose(80, 1) + "</p><p>" + prose(60, 2) + "</p></div></div><div>" + "<a href=y>more links here</a> " * 20 + "</div></body>"
    assert html_text.extract(page) == prose(80, 1) + "\n" + prose(60, 2)


def test_density_decides_inside_articles_and_joins_their_siblings():
    links = "".join(f"<li><a href=x{i}>read story number {i} of today</a></li>" for i in range(12))
    a, b = prose(80, 3), prose(60, 4)
    assert html_text.extract(f"<main><h1>Head</h1><div><p>{a}</p></div><p>Short.</p><div class=more><ul>{links}</ul></div><div><p>{b}</p></div></main>") == f"Head\n{a}\nShort.\n{b}"
    page = f"<div><article><h2>One</h2><p>{a}</p></article><article><ul>{links}</ul></article><article><h2>Two</h2><p>{b}</p><p>End.</p></article></div>"
    assert html_text.extract(page) == f"One\n{a}\nTwo\n{b}\nEnd."


@pytest.mark.parametrize("start", ["<div id=content class='has-sidebar'>", "<div class='no-sidebar'>", "<div class='content-sidebar-wrap'>", "<div class='post comments-open'>", "<div class='with-header'>", "<div class='share-enabled'>", "<form id=aspnetForm>", "<div class='widget'>"])
def test_pages_whose_text_is_in_an_element_named_like_noise(start):
    text, noise = prose(80, 5), "<div class='sidebar'>Links of the side</div><div id=comments><p>Reader says</p></div><form><input>Search</form>"
    end = start[: start.index(" ")].replace("<", "</") + ">"
    assert html_text.extract(f"<body>{start}<h1>Head</h1><p>{text}</p>{noise}{end}</body>") == f"Head\n{text}"


def test_names_inside_an_article_and_hidden_elements():
    a, b = prose(80, 3), prose(60, 4)
    page = f"<body><article><h1>Head</h1><p>{a}</p><div class='legal'>The law says so.</div><div id='discussion'>What it means.</div><div hidden class=x>Unseen</div><p class=y hidden>Unseen too</p><p data-x='hidden' aria-hidden=false>{b}</p><div class='newsletter'>Join us</div><section id=comments><p>Reader says</p></section></article></body>"
    assert html_text.extract(page) == f"Head\n{a}\nThe law says so.\nWhat it means.\n{b}"
    side = "<article><a href=1>Other story</a><a href=2>One more story</a></article>"
    assert html_text.extract(f"<body><div><h1>Head</h1><p>{a}</p><p>{b}</p></div><div>{side * 3}</div></body>") == f"Head\n{a}\n{b}"


def test_density_against_a_recursive_form():
    import math

    def counted(x, in_link=False):
        """chars, link chars, tags, link tags of a tree (tag, children)"""
        if isinstance(x, str):
            return len(x), len(x) if in_link else 0, 0, 0
        parts = [counted(c, in_link or x[0] == "a") for c in x[1]]
        own = [sum(p[k] for p in parts) for k in range(4)]
        own[2] += sum(not isinstance(c, str) for c in x[1])
        own[3] += sum(not isinstance(c, str) and c[0] == "a" for c in x[1])
        return tuple(own)

    def density(c, lc, t, lt, share):
        if not c:
            return 0.0
        base = max(1.1, math.log(c * lc / max(1, c - lc) + share * c + math.e))
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)), base)

    def html(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(html, x[1]))}</{x[0]}>"

    r = random.Random(11)

    def tree(depth, in_link=False):
        tag = r.choice(["div", "section", "div", "span"] + ["a"] * (not in_link))
        children = [prose(r.randint(1, 30), r.random()) if depth > 3 or r.random() < 0.3 else tree(depth + 1, in_link or tag == "a") for _ in range(r.randint(1, 4))]
        return tag, [c for k, c in enumerate(children) if not k or not isinstance(c, str) or not isinstance(children[k - 1], str)]

    for _ in range(40):
        own = ("html", [("div", [tree(1), tree(1), tree(1)])])
        c, lc, *_ = counted(own)
        share, want = lc / c, []

        def visit(x, path, in_link=False):
            a = in_link or x[0] == "a"
            c, lc, t, lt = counted(x, in_link)
            d = density(c, lc, t, max(lt, a), share)
            total = 0.0
            path = path + [d]
            for k in x[1]:
                if isinstance(k, str):
                    total += density(len(k), len(k) if a else 0, 1, 1, share)
                else:
                    total += visit(k, path, a)
            want.append((total, d, min(path), html(x)))
            return d

        visit(own, [])
        nodes = html_text._walk(html_text.parse(html(own)))
        html_text._count(nodes)
        found, threshold = html_text.densest(nodes)
        best = max(want)
        assert abs(threshold - best[2]) < 1e-9 * max(1, threshold)
        assert abs(found.total - max(w[0] for w in want if w[1] >= best[2] - 1e-9)) < 1e-6
        assert sorted(round(n.total, 6) for n in nodes) == sorted(round(w[0], 6) for w in want)


def test_pages_against_a_second_rule():
    """All pages of a generated table: the blocks of the article as the standard library's parser sees them."""
    import os
    from html.parser import HTMLParser

    import pyarrow.parquet as pq

    path = os.environ.get("PAGES", "/root/testdata/sf0.01/pages.parquet")
    if not os.path.exists(path):
        pytest.skip("no pages")

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.lines, self.inside = [""], False

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag not in ("b", "a", "i"):
                self.lines.append("")

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i"):
                self.lines.append("")
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.lines[-1] += data

    for page in pq.read_table(path).column("html").to_pylist():
        if page:
            second = Article()
            second.feed(page)
            assert html_text.extract(page) == "\n".join(x for x in (" ".join(s.split()) for s in second.lines) if x)
