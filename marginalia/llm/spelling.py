"""Spelling variants: words that differ by one code point, found by search schemes over a bidirectional FM-index.

The vocabulary is counted over all texts: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, of at least ``least_length`` code points and ``least`` occurrences.
Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its most frequent near word (then the smallest by code
points) if that is at least ``ratio`` times as frequent; its root is the end of the chain of forms.

One error leaves one half of a word whole. So a word meets the others in two places: those that begin with its first half and those that end with its second. A place
is known by the half; a word of the vocabulary stands at the beginnings and endings that a word of its length, or one more or less, may ask for. Places are dealt to
shards by hash, a crowded half to several with its queries sent to each, so that a shard holds a bounded number of words. A shard's words, sorted, with a delimiter before and
after each, are one text with two FM-indexes, one of it and one of the reversed words; a pattern's suffix-rank intervals in both are kept in step, so that it can grow at either end:

* *first half whole*: the delimiter and the first half are matched to the right, then the second half and the delimiter with one error;
* *second half whole*: the second half and the delimiter are matched to the right, then the first half and the delimiter to the left with one error.

While no error is spent, each step reads the numbers of all symbols that may follow in an interval; a different symbol (replaced), a symbol more (inserted) or one passed over (deleted) branches off, and
branches only match. A match's interval is one word. Of equal edits in a run of a letter only the last is tried, and words that the first search finds are left out of the second, so each near word is
found once. Every shard is searched whole; there is no cap.

Cases: null and empty texts hold no word. A null id is no part of a number, so with ``noise`` nothing is deleted from its words. Repeated rows count each time. Words of any length are
indexed (the rank tables of very long ones are sampled). An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.util import discard, settle

LIMIT = 8192  # words of a shard, about
TABLE = 1 << 24  # numbers in a rank table before it is sampled
FLUSH = 400_000  # words a task holds before it hands their counts on
BROADCAST_ROWS = 500_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RIGHT, LEFT = 0, 1


# vocabulary


def _occurrences(least_length: int, noise: int):
    """Numbers of words in the texts of a task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
        counts.clear()
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in batches:
            for i, text in zip(rows.column(0), rows.column(1), strict=True):
                if not text.is_valid:
                    continue
                own = Counter(_RUN.findall(text.as_py().translate(_LOWER).decode("utf-8", "replace")))
                doc = i.as_py()
                begun = zlib.crc32(f"{doc}:".encode()) if noise and doc is not None else None
                for word, n in own.items():
                    length = len(word)
                    if length < least_length:
                        continue
                    if begun is not None:
                        h = zlib.crc32(word.encode(), begun)
                        if h % noise == 0:
                            at = h % length
                            word = word[:at] + word[at + 1 :]
                            if length == least_length:
                                continue
                    counts[word] += n
                if len(counts) > FLUSH:
                    yield batch(counts)
        yield batch(counts)

    return count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least: int = 5, noise: int = 0) -> DataFrame:
    """word, n. With ``noise``, a word whose crc32 of ``<id>:<word>`` it divides loses, in that document, the code point at the crc32 modulo its length."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_occurrences(least_length, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# the index of a shard


class _Ranks:
    """The BWT of one direction: how many symbols below c stand before a row."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, n_symbols: int):
        """``codes``: the text, delimiters 0 at ``ends`` (the last one is the end of the text)."""
        n = len(codes)
        rank = codes.astype(np.int64) + len(ends)
        rank[ends[:-1]], rank[ends[-1]] = np.arange(1, len(ends)), 0  # words are sorted, so are the delimiters before them
        span = 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: max(n - span, 0)] = rank[span:]
            key = rank * (n + len(ends) + n_symbols + 2) + after
            order = np.argsort(key, kind="stable")
            placed = key[order]
            new = np.concatenate(([0], np.cumsum(placed[1:] != placed[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            span *= 2
        self.bwt = codes[order - 1]
        self.every = 1
        while n * (n_symbols + 3) // self.every > TABLE:
            self.every *= 2
        self.table = np.zeros((n // self.every + 1, n_symbols + 3), np.int32)
        for c in range(1, n_symbols + 3):
            self.table[:, c] = np.concatenate(([0], np.cumsum(self.bwt < c)))[:: self.every]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=n_symbols + 2))))
        if self.every > 1:
            self.bwt = np.concatenate((self.bwt, np.zeros(self.every, self.bwt.dtype)))

    def below(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Symbols smaller than ``c`` before ``rows``."""
        if self.every == 1:
            return self.table[rows, c].astype(np.int64)
        start, rest = rows // self.every, rows % self.every
        places = np.arange(self.every)
        near = self.bwt[(start * self.every)[:, None] + places]
        return self.table[start, c] + ((near < c[:, None]) & (places < rest[:, None])).sum(1)

    def spectrum(self, lo: np.ndarray, hi: np.ndarray, n_symbols: int) -> np.ndarray:
        """Of each interval, its symbols smaller than 0, 1, ... n_symbols + 1."""
        if self.every == 1:
            return self.table[hi, : n_symbols + 2] - self.table[lo, : n_symbols + 2]
        return np.stack([self.below(hi, np.full(len(hi), c)) - self.below(lo, np.full(len(lo), c)) for c in range(n_symbols + 2)], 1)


class Index:
    """A bidirectional FM-index over sorted, different words."""

    def __init__(self, words: list[str]):
        self.words = words
        letters = sorted(set("".join(words)))
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.n_symbols, self.unknown = len(letters), len(letters) + 1
        self.sides = [self._ranks(sorted(w[::-1] for w in words)), self._ranks(words)]  # growing to the right reads the reversed words

    def _ranks(self, words: list[str]) -> _Ranks:
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        code = np.zeros(max(map(ord, self.code), default=0) + 1, np.uint8)
        for c, i in self.code.items():
            code[ord(c)] = i
        codes = code[points]
        return _Ranks(codes, np.flatnonzero(codes == 0), self.n_symbols)

    def codes(self, word: str) -> np.ndarray:
        return np.array([0, *(self.code.get(c, self.unknown) for c in word), 0], np.int64)

    def start(self, n: int) -> np.ndarray:
        """(low rank to the right, low rank to the left, width) of the empty pattern, n times."""
        out = np.zeros((3, n), np.int64)
        out[2] = len(self.sides[0].bwt) if self.sides[0].every == 1 else len(self.sides[0].bwt) - self.sides[0].every
        return out

    def grow(self, at: np.ndarray, c: np.ndarray, side: int) -> np.ndarray:
        """Intervals of patterns with the symbols ``c`` added at a side."""
        ranks, lo, hi = self.sides[side], at[side], at[side] + at[2]
        low, high = ranks.below(lo, c), ranks.below(lo, c + 1)
        smaller = ranks.below(hi, c) - low
        out = np.empty_like(at)
        out[side] = ranks.first[c] + high - low
        out[1 - side] = at[1 - side] + smaller
        out[2] = ranks.below(hi, c + 1) - high - smaller
        return out

    def search(self, queries: list[str], second_whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of near words: with the query's first half whole, or with its second half whole and its first one not."""
        lengths = np.array([len(q) for q in queries], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 2)))
        codes = np.concatenate([self.codes(q) for q in queries]) if queries else np.zeros(0, np.int64)
        half, base = lengths // 2, starts[:-1]
        # positions of the pattern: 0 is the delimiter, then the word, then the delimiter
        place, upto = (half + 1, lengths + 1) if second_whole else (np.zeros_like(half), half)
        q, at = np.arange(len(queries)), self.start(len(queries))
        while True:
            go = place[q] <= upto[q]
            if not go.any():
                break
            grown = self.grow(at[:, go], codes[base[q[go]] + place[q[go]]], RIGHT)
            at = at.copy()
            at[:, go] = grown
            place = place.copy()
            place[q[go]] += 1
            alive = at[2] > 0
            q, at = q[alive], at[:, alive]
        side, step = (LEFT, -1) if second_whole else (RIGHT, 1)
        p = half[q] if second_whole else half[q] + 1
        q1, p1, at1 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((3, 0), np.int64)
        found_q, found_x = [], []
        while len(q) or len(q1):
            if len(q1):  # one error spent: match
                at1 = self.grow(at1, codes[base[q1] + p1], side)
                p1 = p1 + step
                ended = (p1 < 0) | (p1 > lengths[q1] + 1)
                hit = ended & (at1[2] > 0)
                found_q.append(q1[hit])
                found_x.append(at1[LEFT][hit] - 1)  # rows 1, 2, ... are the delimiters before the words
                alive = ~ended & (at1[2] > 0)
                q1, p1, at1 = q1[alive], p1[alive], at1[:, alive]
            if len(q):
                c = codes[base[q] + p]
                inner = c != 0
                smaller = self.sides[side].spectrum(at[side], at[side] + at[2], self.n_symbols)
                widths = np.diff(smaller, axis=1)[:, 1:]  # of the letters 1, 2, ...
                i, x = np.nonzero(widths)
                x = x + 1
                other = x != c[i]
                i, x = i[other], x[other]
                branch = self.grow(at[:, i], x, side)
                replaced = inner[i]
                following = codes[base[q] + np.clip(p + step, 0, lengths[q] + 1)]
                passed = inner & (following != c)  # of a run, only its last letter
                q1 = np.concatenate((q1, q[i], q[i][replaced], q[passed]))
                p1 = np.concatenate((p1, p[i], p[i][replaced] + step, p[passed] + step))
                at1 = np.concatenate((at1, branch, branch[:, replaced], at[:, passed]), 1)
                at = self.grow(at, c, side)
                p = p + step
                alive = (at[2] > 0) & (p >= 0) & (p <= lengths[q] + 1)
                q, p, at = q[alive], p[alive], at[:, alive]
        found_q, found_x = np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found_x])
        if second_whole:
            new = np.array([not self.words[x].startswith(queries[i][: len(queries[i]) // 2]) for i, x in zip(found_q.tolist(), found_x.tolist(), strict=True)], bool)
            found_q, found_x = found_q[new], found_x[new]
        return found_q, found_x


# the search


def _placed(words: DataFrame, limit: int) -> DataFrame:
    """shard, second (whether its second halves are whole), asks (whether a query), word, n."""
    n = F.length("word")
    first = [F.floor(F.greatest(n + d, F.lit(2)) / 2).cast("int") for d in (-1, 0, 1)]
    second = [F.greatest(n + d, F.lit(2)) - h for d, h in zip((-1, 0, 1), first, strict=True)]
    ends = lambda lengths, cut: F.explode(F.array_distinct(F.transform(F.array(*lengths), cut)))
    begins = words.select(F.lit(False).alias("second"), "word", "n", ends(first, lambda k: F.substring("word", F.lit(1), k)).alias("half"))
    closes = words.select(F.lit(True).alias("second"), "word", "n", ends(second, lambda k: F.expr("word").substr(F.greatest(n - k, F.lit(0)) + 1, k)).alias("half"))
    kept = settle(begins.unionByName(closes), "halves")
    own = F.floor(n / 2).cast("int")
    asks = words.select(F.lit(False).alias("second"), "word", "n", F.substring("word", F.lit(1), own).alias("half")).unionByName(words.select(F.lit(True).alias("second"), "word", "n", F.expr("word").substr(own + 1, n - own).alias("half")))
    total = kept.count()
    spark = words.sparkSession
    shards = max(-(-total // limit), spark.sparkContext.defaultParallelism)
    crowded = settle(kept.groupBy("second", "half").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit).withColumn("parts", F.ceil(F.col("m") / limit).cast("int")).drop("m"), "crowded")
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    parts = F.coalesce("parts", F.lit(1))
    kept = kept.join(few, ["second", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    asks = asks.join(few, ["second", "half"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = kept.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)))
    return rows.select(F.pmod(F.xxhash64("second", "half", "part"), F.lit(shards)).cast("int").alias("shard"), "second", "asks", "word", "n")


def _search(rows: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: of one shard."""
    asks = np.asarray(rows.column("asks").combine_chunks().to_numpy(zero_copy_only=False), bool)
    words, n = np.array(rows.column("word").to_pylist(), object), rows.column("n").to_numpy()
    known = dict(zip(words[~asks].tolist(), n[~asks].tolist(), strict=True))
    queries = sorted(set(words[asks].tolist()))
    out: tuple[list, list, list, list] = ([], [], [], [])
    if known and queries:
        held = sorted(known)
        index, numbers = Index(held), np.array([known[w] for w in held], np.int64)
        q, x = index.search(queries, rows.column("second")[0].as_py())
        order = np.lexsort((x, -numbers[x], q))
        q, x = q[order], x[order]
        at = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        near = np.diff(np.concatenate((at, [len(q)])))
        out = ([queries[i] for i in q[at]], near.tolist(), numbers[x[at]].tolist(), [held[i] for i in x[at]])
    return pa.table([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def near(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n_near, best_n, best of every word (word, n) that has a near word."""
    found = _placed(words, limit).groupBy("second", "shard").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): each round doubles the way, and a form is ``ratio`` times as frequent, so a few rounds do."""
    links = settle(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        discard(links)
        links = moved.select("word", "root")
        links.settled_in = moved.settled_in
        if not moved.where("moved").limit(1).count():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least: int = 5, ratio: int = 5, noise: int = 0, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the vocabulary."""
    if least_length < 2 or ratio < 2:
        raise ValueError("words have halves from two code points on, and forms are more frequent than their variants")
    words = settle(vocabulary(docs, id_col, text_col, least_length, least, noise), "vocabulary")
    found = near(words, limit)
    good = F.col("best_n") >= F.lit(ratio) * F.col("n")
    judged = settle(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "near_words")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
