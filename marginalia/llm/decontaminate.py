"""Benchmark decontamination: windows of the items' length, bounded by shared shingle weight, verified exactly.

A document is contaminated by an item when a window of as many words as the item holds at least 0.8 of the weight of the item's
five-word shingles (an item of fewer words is one shingle). A shingle weighs log(1 + items / items that have it), over all items.

1. An index of the items' shingles gives, for each document and item, the shared shingles and their places. An item whose shared weight in the
   whole document is below 0.8 of its own matches no window of it.
2. A window that begins at its first shared shingle holds all that an earlier begin would hold; so windows begin at shared shingles, and where a
   shared shingle would put the item's first word (that is the place reported). Windows whose shared places weigh too little are left out: a bound from above.
3. The rest are verified by exact weighted similarity, so nothing is lost against a search of all windows.

A SimHash of the words within radius 19 (``Items.candidates``, in 20 Hamming blocks) does not decide: it counts all words alike, and windows that hold 0.8 of
the weight can be farther away.

Benchmarks are read in blocks of at most about 8 MB of text. A block is broadcast to one pass over all documents, whose matches are written before the next block is read, so memory does not grow with the
number of blocks. The decision for a document needs only its own text: a benchmark of one block shuffles nothing, several blocks shuffle matches.

Cases: null and empty texts and texts without words are clean; null, empty or wordless items match nothing; repeated documents get
the same result, repeated items each their own id; an item of null id is not matched. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm import words as wd
from marginalia.llm.util import numbered, settle

SIMILARITY, SHINGLE, RADIUS = 0.8, 5, 19
BLOCK_BYTES = 8 << 20
_PAIRS = 1 << 20
_WIDTHS = [3] * 16 + [4] * 4  # RADIUS + 1 blocks, 64 bits
_STARTS = np.concatenate(([0], np.cumsum(_WIDTHS)))[:-1]
RESULT = "struct<item_ids: array<long>, similarities: array<double>, first_words: array<long>>"


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _bit_blocks(fingerprint: int) -> list[int]:
    return [(fingerprint >> int(s)) & ((1 << w) - 1) for s, w in zip(_STARTS, _WIDTHS)]


def item_shingles(words: np.ndarray) -> np.ndarray:
    k = min(SHINGLE, len(words))
    return wd.chain(words, k)[: len(words) - k + 1]


def _runs(size: np.ndarray):
    """Runs of places that have about _PAIRS entries together."""
    upto, x = np.cumsum(size), 0
    while x < len(size):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + _PAIRS, "right")))
        yield x, y
        x = y


class _Slice(list):
    """The same hits, for a call that has some of the items."""


class Items:
    """The items of one block of the benchmark."""

    def __init__(self, ids: list[int], bodies: list[str], similarity: float = SIMILARITY, n_items: int | None = None, shared: tuple[np.ndarray, np.ndarray] | None = None):
        """``n_items`` and ``shared`` (shingles, sorted, and the items that have them): counts over all items, where these are one block of them."""
        self.similarity = similarity
        (_, _, buf, offs), *_ = wd.text_slices(pa.array(bodies, pa.large_string()), 1 << 62)
        h, _, _, first = wd.words(buf, offs)
        self.n_words = np.diff(first)
        has = np.flatnonzero(self.n_words)
        self.ids = np.array(ids, np.int64)[has]
        parts = [h[first[i] : first[i + 1]] for i in has]
        self.n_words = self.n_words[has]
        self.fingerprints = np.array([simhash(p) for p in parts], np.uint64)
        # shingles of each item by length (items of one to four words have one shingle of that length)
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        places: dict[int, list] = {}
        for i, p in enumerate(parts):
            s = item_shingles(p)
            places.setdefault(min(SHINGLE, len(p)), []).append((s, np.full(len(s), i), np.arange(len(s))))
            self.own.append(np.unique(s, return_counts=True))
        every, df = np.unique(np.concatenate([s for s, _ in self.own]) if parts else np.zeros(0, np.uint64), return_counts=True)
        if shared is not None and len(shared[0]) and len(every):
            at = np.minimum(np.searchsorted(shared[0], every), len(shared[0]) - 1)
            df = np.where(shared[0][at] == every, shared[1][at], df)
        self.every, self.weight = every, np.log(1 + (len(parts) if n_items is None else n_items) / np.maximum(df, 1))
        self.total = [float((c * self._weigh(s)).sum()) for s, c in self.own]
        self.places = {}
        for k, found in places.items():
            s, item, offset = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((offset, item, s))
            gate = np.zeros(1 << 20, bool)
            gate[(s >> np.uint64(44)).view(np.int64)] = True
            self.places[k] = (s[order], item[order], offset[order], gate)

    @cached_property
    def tables(self) -> list[np.ndarray]:
        tables = [np.zeros((1 << w, len(self.ids)), bool) for w in _WIDTHS]
        for i, f in enumerate(self.fingerprints.tolist()):
            for table, value in zip(tables, _bit_blocks(f)):
                table[value, i] = True
        return tables

    def _weigh(self, s: np.ndarray) -> np.ndarray:
        return self.weight[np.searchsorted(self.every, s)]

    def candidates(self, fingerprint: int) -> np.ndarray:
        """Items whose fingerprint is within RADIUS: those that share a block, then by distance."""
        near = np.zeros(len(self.ids), bool)
        for table, value in zip(self.tables, _bit_blocks(fingerprint)):
            near |= table[value]
        near = np.flatnonzero(near)
        return near[np.bitwise_count(self.fingerprints[near] ^ np.uint64(fingerprint)) <= RADIUS]

    def similar(self, item: int, window: np.ndarray) -> float:
        k = min(SHINGLE, int(self.n_words[item]))
        if len(window) < k:
            return 0.0
        s, c = np.unique(wd.chain(window, k)[: len(window) - k + 1], return_counts=True)
        own, tf = self.own[item]
        _, x, y = np.intersect1d(own, s, assume_unique=True, return_indices=True)
        return float((np.minimum(tf[x], c[y]) * self._weigh(own[x])).sum()) / self.total[item]

    def _match(self, h, first, k, at, lo, hi, doc, hits) -> None:
        """Matches of some documents with the items whose shingles have k words. ``lo``, ``hi``: entries of the index with the shingle at ``at``."""
        table, item, offset, _ = self.places[k]
        size, n_ids = hi - lo, len(self.ids)
        slices = min(n_ids, int(size.sum()) // (4 * _PAIRS) + 1)
        if slices > 1 and lo.size and not isinstance(hits, _Slice):  # a long document of very common shingles: some items at a time
            rank = np.concatenate(([0], np.cumsum(table[1:] != table[:-1])))
            key, base = rank * n_ids + item, rank[lo] * n_ids
            edges = np.linspace(0, n_ids, slices + 1).astype(np.int64)
            for u, v in zip(edges[:-1].tolist(), edges[1:].tolist()):
                self._match(h, first, k, at, np.searchsorted(key, base + u), np.searchsorted(key, base + v), doc, _Slice(hits))
            return
        m = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lo, size)
        place, pair, entry = np.repeat(at, size), np.repeat(doc, size) * len(self.ids) + item[m], table[m]
        once = np.ones(len(m), bool)  # an item that repeats a shingle has an entry for each, side by side
        once[1:] = (place[1:] != place[:-1]) | (pair[1:] != pair[:-1])
        weight = np.where(once, self._weigh(entry), 0.0)
        pairs, group = np.unique(pair, return_inverse=True)
        # an item's whole weight is the most that a shared place can be worth; the least needed tells which pairs can match
        need = (self.similarity - 1e-9) * np.array(self.total)[pairs % len(self.ids)]
        able = np.bincount(group, weight, len(pairs)) >= need * (1 - 1e-9)
        order = np.flatnonzero(able[group])
        order = order[np.argsort(group[order], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            g = group[part[0]]
            d, i = divmod(int(pairs[g]), len(self.ids))
            begin, end, n = int(first[d]), int(first[d + 1]), int(self.n_words[i])
            p, w = place[part], np.concatenate(([0.0], np.cumsum(weight[part])))
            starts = np.unique(np.concatenate((p, np.maximum(begin, p - offset[m[part]]))))
            bound = w[np.searchsorted(p, starts + n - k, "right")] - w[np.searchsorted(p, starts, "left")]
            fit = bound >= need[g] * (1 - 1e-9) - 1e-9
            starts, bound = starts[fit], bound[fit] / self.total[i] + 1e-9
            best = None
            for j in np.lexsort((starts, -bound)).tolist():
                start = int(starts[j])
                if best is not None and (bound[j] < best[0] or best[0] >= 1 - 1e-9 and start > best[1]):
                    continue
                sim = self.similar(i, h[start : min(end, start + n)])
                if sim >= self.similarity - 1e-9 and (best is None or (-sim, start) < (-best[0], best[1])):
                    best = (sim, start)
            if best is not None:
                hits[d][i] = best

    def search(self, column: pa.Array) -> pa.Array:
        found: list[dict[int, tuple[float, int]]] = []
        for a, b, buf, offs in wd.text_slices(column):
            h, _, _, first = wd.words(buf, offs)
            hits: list[dict[int, tuple[float, int]]] = [{} for _ in range(b - a)]
            for k, (table, item, offset, gate) in self.places.items():
                s = wd.chain(h, k)
                at = np.flatnonzero(gate[(s >> np.uint64(44)).view(np.int64)])
                lo, hi = np.searchsorted(table, s[at], "left"), np.searchsorted(table, s[at], "right")
                doc = np.searchsorted(first, at, "right") - 1
                inside = (hi > lo) & (at + k <= first[doc + 1])
                at, lo, hi, doc = at[inside], lo[inside], hi[inside], doc[inside]
                for x, y in _runs(hi - lo):
                    # runs end between documents, unless one document alone is longer
                    x = int(np.searchsorted(doc, doc[x], "left")) if x else x
                    y = int(np.searchsorted(doc, doc[y], "left")) if y < len(doc) else y
                    if x < y:
                        self._match(h, first, k, at[x:y], lo[x:y], hi[x:y], doc[x:y], hits)
            for d, x in enumerate(hits):
                found.append({int(self.ids[i]): (sim, start - int(first[d])) for i, (sim, start) in x.items()})
        rows = [sorted(x.items()) for x in found]
        return pa.array([{"item_ids": [i for i, _ in r], "similarities": [s for _, (s, _) in r], "first_words": [w for _, (_, w) in r]} for r in rows], pa.struct([("item_ids", pa.list_(pa.int64())), ("similarities", pa.list_(pa.float64())), ("first_words", pa.list_(pa.int64()))]))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text) to (block, shingle, items): a row for each shingle of an item, and one that counts the items with words."""
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, buf, offs in wd.text_slices(batch.column(1)):
            h, _, _, first = wd.words(buf, offs)
            for i in range(b - a):
                if first[i] < first[i + 1]:
                    s = np.unique(item_shingles(h[first[i] : first[i + 1]])).view(np.int64)
                    n = len(s)
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(n + 1, blocks[a + i])), "shingle": pa.array([*s.tolist(), None], pa.int64()), "items": pa.array([0] * n + [1], pa.int64())})


def _blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[Callable[[Column], Column]]]:
    """How many blocks of items there are, and of one after the other a function from a text column to the column of its matches (RESULT)."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND length(text) > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = size // block_bytes + 1
    sc = items.sparkSession.sparkContext

    def each() -> Iterator[Callable[[Column], Column]]:
        n_items = counts = None
        if n_blocks > 1:  # weights are counted once, over all items; a shingle of one item alone needs no row
            dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
            every = settle(dealt.select("block", "text").mapInArrow(_shingles, "block long, shingle long, items long"), "item_shingles")
            n_items = every.agg(F.sum("items")).first()[0] or 0
            df = every.where("shingle IS NOT NULL").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            counts = settle(every.join(df, "shingle").select("block", "shingle", "n").distinct(), "item_counts")
        for block in range(n_blocks):
            part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id").collect()  # about block_bytes
            common = None
            if counts is not None:
                found = counts.where(F.col("block") == block).collect()  # at most the shingles of the block
                common = np.array([r["shingle"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
                order = np.argsort(common[0])
                common = common[0][order], common[1][order]
            if part:
                shared = sc.broadcast(Items([r["item_id"] for r in part], [r["text"] for r in part], similarity, n_items, common))
                search = _search(shared)
                yield lambda text, search=search: search(F.coalesce(text.cast("string"), F.lit("")))
                if n_blocks > 1:
                    shared.unpersist()

    return n_blocks, each()


def _found(rows: DataFrame, blocks: Iterator[Callable[[Column], Column]]) -> DataFrame | None:
    """row, m (RESULT, by item id) of rows (row, text) that have a match: a pass for each block."""
    every = None
    for search in blocks:
        matched = rows.select("row", search(F.col("text")).alias("m")).where(F.size("m.item_ids") > 0)
        one = settle(matched.select("row", F.explode(F.arrays_zip("m.item_ids", "m.similarities", "m.first_words")).alias("x")), "matches")
        every = one if every is None else every.unionByName(one)
    if every is None:
        return None
    lists = every.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lists.select("row", F.struct(*[F.col("x").getField(n).alias(n) for n in ("item_ids", "similarities", "first_words")]).alias("m"))


def _search(shared):
    @F.arrow_udf(RESULT)
    def search(text: pa.Array) -> pa.Array:
        return shared.value.search(text)

    return search


def annotate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, similarities, first_words (parallel arrays, by item id)."""
    n_blocks, blocks = _blocks(items, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if n_blocks == 1:
        search = next(blocks, None)
        rows = rows.select("doc_id", search(F.col("text")).alias("m") if search else F.lit(None).cast(RESULT).alias("m"))
    else:
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "documents")  # a row keeps its number in every pass
        found = _found(rows, blocks)
        rows = rows.drop("text").join(found, "row", "left") if found is not None else rows.withColumn("m", F.lit(None).cast(RESULT))
    none = F.array().cast("array<long>")
    return rows.select("doc_id", F.coalesce(F.size("m.item_ids") > 0, F.lit(False)).alias("contaminated"), F.coalesce("m.item_ids", none).alias("item_ids"), F.coalesce("m.similarities", F.array().cast("array<double>")).alias("similarities"), F.coalesce("m.first_words", none).alias("first_words"))


def keep(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The clean rows of ``docs``, with all their columns."""
    n_blocks, blocks = _blocks(items, **options)
    if n_blocks == 1:
        search = next(blocks, None)
        return docs.where(F.coalesce(F.size(search(docs[text_col])["item_ids"]), F.lit(0)) < 1) if search else docs
    packed = numbered(docs, "documents")
    found = _found(packed.select("row", F.col("doc").getField(text_col).cast("string").alias("text")), blocks)
    return (packed if found is None else packed.join(found.select("row"), "row", "left_anti")).select("doc.*")
