"""Near-duplicate groups: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. ``Idf.fit``: the document frequency of five-word shingles over all documents, in a table of fixed size (2**20 counters, by
   hash; what other shingles of a cell are expected to add is taken off). A shingle weighs its count in the text times an IDF scaled
   to 1..1.5 by the number of documents, so weights mean the same at every corpus size, and a text that is
   copied very often does not lose its copies: what its copies share is frequent, what parts them is rare.
2. Texts of equal word sequence form a class (pre-aggregated, so a class of any size is one row from here on); each class has
   30 samples of improved consistent weighted sampling, in 10 bands of 3: at similarity 0.8 a pair meets with probability 0.999.
3. Buckets are not expanded into pairs. Each class is verified against the least member of a bucket, and the links give
   components: first with one bucket for each class, then with every bucket whose least member is in another component.
   In buckets that still hold several components, blocks of the members outside the bucket's largest component are compared with all blocks of
   the bucket, so no cap is needed. A task writes a link only if it joins two components that its links before have not joined, and compares
   no texts of joined ones, so its links are fewer than its components, and a group of near copies is not compared within itself.

Cases: null and empty texts, and texts without a word, have no shingles and are in no group. A text of fewer than five words
is one shingle. A row without an id is grouped but never represents others that have one. Rows are known by id and a hash of the text, so two texts of one
id, or of no id, are decided each on its own. Of equal ids with equal texts, ``keep`` returns one row; rows without an id and without a word all stay.
An empty table gives an empty table. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import words as wd
from marginalia.llm.graph import components
from marginalia.llm.util import discard, fresh, field, settle, spread_join, texts

SIMILARITY, SHINGLE = 0.8, 5
BANDS, ROWS = 10, 3
CELLS, CHUNKS = 1 << 20, 64
_BLOCK = 1 << 15
BLOCK_DOCS, BLOCK_WEIGHT = 64, 100_000.0


def _sorted_shingles(column: pa.Array):
    """For runs of rows: (first row, end row, word hashes, first words, unique shingles by text, counts, first shingle of each text)."""
    for a, b, buf, offs in wd.text_slices(column):
        h, _, _, first = wd.words(buf, offs)
        s, _, at = wd.shingles(h, first, SHINGLE)
        s = s.copy()
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            s[i:j].sort()
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        new[at[:-1][np.diff(at) > 0]] = True
        where = np.flatnonzero(new)
        count = np.diff(np.append(where, len(s)))
        yield a, b, h, first, s[where], count, np.searchsorted(where, at)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).view(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        docs += batch.num_rows
        for *_, s, _, _ in _sorted_shingles(batch.column(0)):
            counts += np.bincount(_cell(s), minlength=CELLS)
    if docs:
        parts = counts.astype(np.uint32).reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "docs": pa.array([docs] + [0] * (CHUNKS - 1), pa.int64()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for chunk, docs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault(chunk, [0, np.zeros(CELLS // CHUNKS, np.int64)])
            own[0] += docs
            own[1] += np.frombuffer(zlib.decompress(counts), np.uint32)
    if sums:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(sums, pa.int32()), "docs": pa.array([x[0] for x in sums.values()], pa.int64()), "counts": pa.array([x[1].tobytes() for x in sums.values()], pa.binary())})


class Idf:
    """IDF by shingle hash: 2**20 numbers, whatever the corpus."""

    def __init__(self, counts: np.ndarray, docs: int):
        counts = counts.astype(np.float64)
        others = (counts.sum() - counts) / (CELLS - 1)
        df = np.clip(counts - others, 1, max(docs, 1))
        self.table = (1 + 0.5 * np.log((docs + 1) / (df + 1)) / np.log(max(docs, 1) + 1)).clip(1, 1.5)

    @classmethod
    def fit(cls, rows: DataFrame) -> Idf:
        schema = "chunk int, docs long, counts binary"
        parts = rows.select("text").mapInArrow(_count_cells, schema).repartition(CHUNKS, "chunk").mapInArrow(_add_cells, schema)
        counts, docs = np.zeros((CHUNKS, CELLS // CHUNKS), np.int64), 0
        for r in parts.collect():  # CHUNKS rows of fixed size
            counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
            docs += r["docs"]
        return cls(counts.ravel(), docs)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return self.table[_cell(s)]


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted sampling: for each k, r and c are Gamma(2, 1) and beta uniform, all fixed by shingle and k."""

    def __init__(self, samples: int, seed: int = 1):
        q = _gamma_quantiles()
        self.r, self.log_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.odd = np.random.default_rng(seed).integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, s: np.ndarray, log_w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Samples by (k, text), for texts that each have a shingle; ``at``: first shingle of each text."""
        size = np.diff(np.append(at, len(s)))
        owner = np.repeat(np.arange(len(at)), size)
        out = np.empty((len(self.odd), len(at)), np.uint64)
        for k, odd in enumerate(self.odd):
            x = s * odd
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            r = self.r.take((x >> np.uint64(48)).view(np.int64))
            c = self.log_c.take(((x >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64))
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32)
            beta *= np.float32(1 / 65536)
            t = log_w / r
            t += beta
            np.floor(t, out=t)
            a = t - beta
            a += np.float32(1)
            a *= r
            np.subtract(c, a, out=a)
            least = np.minimum.reduceat(a, at)
            hit = np.flatnonzero(a == least[owner])
            hit = hit[np.searchsorted(hit, at)]
            out[k] = wd.mix(s[hit] + (t[hit].astype(np.int64).view(np.uint64) << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        return out


def _signatures(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sampler = idf.value.table, Sampler(BANDS * ROWS)
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for a, b, h, first, s, count, at in _sorted_shingles(batch.column(1)):
                n = b - a
                weight = count * table[_cell(s)]
                log_w = np.log(weight).astype(np.float32)
                bands, total = np.zeros((BANDS, n), np.uint64), np.zeros(n)
                full = np.flatnonzero(np.diff(at))
                start = at[full]
                if len(full):
                    total[full] = np.add.reduceat(weight, start)
                i = 0
                while i < len(full):  # blocks that stay in cache
                    j = max(i + 1, int(np.searchsorted(start, start[i] + _BLOCK)))
                    lo, hi = start[i], start[j] if j < len(full) else len(s)
                    got = sampler(s[lo:hi], log_w[lo:hi], start[i:j] - lo)
                    for band in range(BANDS):
                        key = np.full(j - i, band + 1, np.uint64)
                        for row in range(ROWS):
                            key = wd.mix(key * np.uint64(0xD6E8FEB86659FD93) + got[band * ROWS + row])
                        bands[band, full[i:j]] = key
                    i = j
                k1, k2 = wd.text_key(h, first)
                columns = {"doc_id": ids.slice(a, n), "mark": marks.slice(a, n), "n": pa.array(np.diff(at), pa.int64()), "weight": pa.array(total), "k1": pa.array(k1), "k2": pa.array(k2)}
                yield pa.RecordBatch.from_pydict(columns | {f"b{k}": pa.array(bands[k].view(np.int64)) for k in range(BANDS)})

    return run


def _similar(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value.table
        for batch in batches:
            step = 256
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                sides = [[x for *_, s, c, at in _sorted_shingles(part.column(k)) for x in zip(np.split(s, at[1:-1]), np.split(c, at[1:-1]))] for k in (2, 3)]
                sims = np.zeros(part.num_rows)
                for i, ((s, c), (t, d)) in enumerate(zip(*sides)):
                    _, x, y = np.intersect1d(s, t, assume_unique=True, return_indices=True)
                    both = float((np.minimum(c[x], d[y]) * table[_cell(s[x])]).sum())
                    either = float((c * table[_cell(s)]).sum() + (d * table[_cell(t)]).sum()) - both
                    sims[i] = both / either if either else 0.0
                ok = np.flatnonzero(sims >= least - 1e-9)
                yield pa.RecordBatch.from_pydict({"a": part.column(0).take(pa.array(ok)), "b": part.column(1).take(pa.array(ok)), "similarity": pa.array(sims[ok])})

    return run


class Joined:
    """Which labels the links of a task have joined so far. Forgetting them costs links that say nothing new, and loses none."""

    MOST = 1_000_000

    def __init__(self):
        self.above: dict[int, int] = {}

    def roots(self, labels: list[int]) -> np.ndarray:
        out = []
        for x in labels:
            root = x
            while root in self.above:
                root = self.above[root]
            while x != root:
                self.above[x], x = root, self.above[x]
            out.append(root)
        return np.array(out, np.int64)

    def join(self, a: int, b: int) -> None:
        self.above[a] = b


def _across(idf, least: float):
    """Rows of two blocks of texts to links between texts of different labels: those that join labels which the task's links before have not joined,
    so a task has fewer links than labels. Texts of joined labels are not compared."""

    def shingles(part: pa.StructArray):
        s, c, n = [], [], []
        for *_, own, count, at in _sorted_shingles(part.field("text")):
            s.append(own)
            c.append(count)
            n.append(np.diff(at))
        return np.concatenate(s), np.concatenate(c), np.concatenate(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, joined = idf.value.table, Joined()
        for batch in batches:
            for row in range(batch.num_rows):
                if len(joined.above) > Joined.MOST:
                    joined = Joined()
                part_a, part_b = (batch.column(k)[row].values for k in (0, 1))
                roots, roots_b = (joined.roots(x.field("label").to_pylist()) for x in (part_a, part_b))
                if (roots == roots[0]).all() and (roots_b == roots[0]).all():
                    continue
                (s, c, n), (t, d, m) = shingles(part_a), shingles(part_b)
                reps, reps_b = (x.field("rep").to_pylist() for x in (part_a, part_b))
                weight_b = table[_cell(t)]
                total_b = np.add.reduceat(d * weight_b, np.cumsum(m) - m)
                links = []
                for i, (begin, end) in enumerate(zip((np.cumsum(n) - n).tolist(), np.cumsum(n).tolist())):
                    open_b = np.flatnonzero(roots_b != roots[i])
                    if not len(open_b):
                        continue
                    own, count = s[begin:end], c[begin:end]
                    total = float((count * table[_cell(own)]).sum())
                    inside = np.repeat(roots_b != roots[i], m)
                    other, size = t[inside], m[open_b]
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = np.add.reduceat(np.where(own[at] == other, np.minimum(count[at], d[inside]) * weight_b[inside], 0.0), np.cumsum(size) - size)
                    for k in open_b[both >= (least - 1e-9) * (total + total_b[open_b] - both)].tolist():
                        mine, its = int(roots[i]), int(roots_b[k])
                        if mine != its:
                            joined.join(mine, its)
                            roots[roots == mine], roots_b[roots_b == mine] = its, its
                            links.append((reps[i], reps_b[k]))
                if links:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _mark(doc_id, text):
    """A hash of the text, another one where there is no id: with the id (0 for none) it tells rows apart."""
    return F.xxhash64(doc_id.isNull(), text)


def _decided(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """The columns of ``groups``, and mark and lone (no word) of each row; and the settled tables that they are read from.

    A class is numbered (``rep``) once, when the classes are written; its representative row is ``rep_id`` and ``rep_mark``."""
    rows = texts(docs, id_col, text_col)
    rows = rows.withColumn("mark", _mark(F.col("doc_id"), F.col("text")))
    sc = docs.sparkSession.sparkContext
    idf = sc.broadcast(Idf.fit(rows))
    schema = "doc_id long, mark long, n long, weight double, k1 long, k2 long, " + ", ".join(f"b{k} long" for k in range(BANDS))
    signed = settle(rows.mapInArrow(_signatures(idf), schema), "signatures")

    bands = [f"b{k}" for k in range(BANDS)]
    reps = settle(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep_id"), F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("rep_mark"), F.first("weight").alias("weight"), *[F.first(b).alias(b) for b in bands]).withColumn("rep", F.monotonically_increasing_id()), "classes")
    placed = reps.select("rep", "weight", F.explode(F.array(*bands)).alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = settle(spread_join(placed, buckets, "bucket", "rep"), "members")
    wanted = members.select("rep").distinct().join(reps.select("rep", F.coalesce("rep_id", F.lit(0)).alias("id"), F.col("rep_mark").alias("mark")), "rep")
    # texts are sorted to their ids at every size; a broadcast where the ids happen to be few would make the plan another one at scale
    bodies = settle(rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "text").join(wanted.hint("merge"), ["id", "mark"]).dropDuplicates(["id", "mark"]).select("rep", "text"), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (bodies.select(F.col("rep").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return settle(joined.mapInArrow(_similar(idf, similarity), "a long, b long, similarity double"), "links")

    def labelled(table: DataFrame, column: str, by: str, labels: DataFrame, name: str) -> DataFrame:
        named = labels.select(F.col("node").alias(column), F.col("label").alias(name))
        return spread_join(table, named, column, by, "left").withColumn(name, F.coalesce(name, column))

    done = [members, bodies]  # settled tables that the result does not read
    # one bucket for each class
    tried = settle(members.groupBy(F.col("rep").alias("a")).agg(F.min("lead").alias("b")).where("a <> b"), "pairs")
    links = verified(tried)
    labels = components(links)
    done += [tried, links]
    # every bucket whose least member is in another component
    pairs = labelled(labelled(members.select(F.col("rep").alias("a"), F.col("lead").alias("b")).where("a <> b").distinct(), "a", "b", labels, "la"), "b", "a", labels, "lb")
    pairs = settle(pairs.where("la <> lb").select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
    more = verified(pairs)
    done += [pairs, more]
    if not more.isEmpty():
        done.append(labels)
        links = links.unionByName(more)
        labels = components(links)
    # what still shares a bucket across components: blocks of the members outside the bucket's largest component against all its blocks
    joint = settle(labelled(members, "rep", "bucket", labels, "label"), "members")
    mixed = joint.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    done.append(joint)
    joint = settle(spread_join(joint, mixed, "bucket", "rep").select("bucket", "rep", "label", "weight"), "mixed")
    done.append(joint)
    if not joint.isEmpty():
        shares = joint.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
        largest = shares.groupBy("bucket").agg(F.max(F.struct("n", "label", "w")).alias("g"), F.sum("n").alias("n"), F.sum("w").alias("w"))

        def n_blocks(n, w):
            return F.ceil(F.greatest(n / F.lit(BLOCK_DOCS), w / F.lit(BLOCK_WEIGHT))).cast("long")

        largest = largest.select("bucket", F.col("g.label").alias("giant"), n_blocks(F.col("g.n"), F.col("g.w")).alias("in_giant"), n_blocks(F.col("n") - F.col("g.n"), F.col("w") - F.col("g.w")).alias("in_rest"))
        placed = spread_join(joint, largest, "bucket", "rep").withColumn("is_giant", F.col("label") == F.col("giant"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("is_giant"), F.col("in_giant")).otherwise(F.col("in_rest")))))
        placed = placed.select("bucket", "is_giant", "block", "rep", "label").join(bodies, "rep")
        blocks = settle(placed.groupBy("bucket", "is_giant", "block").agg(F.collect_list(F.struct("rep", "label", "text")).alias("docs")), "blocks")
        rest = blocks.where(~F.col("is_giant")).select("bucket", F.col("block").alias("block_a"), F.col("docs").alias("docs_a"))
        others = blocks.select("bucket", "is_giant", F.col("block").alias("block_b"), F.col("docs").alias("docs_b"))
        opposite = rest.join(others, "bucket").where(F.col("is_giant") | (F.col("block_a") <= F.col("block_b"))).select("docs_a", "docs_b")
        more = settle(opposite.mapInArrow(_across(idf, similarity), "a long, b long"), "links")
        done += [blocks, more]
        if not more.isEmpty():
            done.append(labels)
            labels = components(links.select("a", "b").unionByName(more))
    discard(*done)

    # a component is represented by the representative of least id among its classes, those without an id last
    linked = labels.join(reps.select(F.col("rep").alias("node"), "rep_id", "rep_mark"), "node")
    heads = linked.groupBy("label").agg(F.min(F.struct(F.col("rep_id").isNull().alias("missing"), "rep_id", "rep_mark")).alias("head"))
    heads = labels.join(heads, "label").select(F.col("node").alias("rep"), "head")
    own = F.struct(F.col("rep_id").isNull().alias("missing"), "rep_id", "rep_mark")
    found = reps.select("rep", "k1", "k2", "rep_id", "rep_mark").join(heads, "rep", "left").select("k1", "k2", F.col("rep_id").alias("class_id"), F.coalesce("head", own).alias("head"))
    out = signed.select("doc_id", "mark", "n", "k1", "k2").join(found, ["k1", "k2"], "left")
    lone = F.col("n") == 0
    out = out.select(
        "doc_id", "mark", lone.alias("lone"), F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.rep_id")).alias("group_id"), F.when(lone, F.col("mark")).otherwise(F.col("head.rep_mark")).alias("group_mark"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("mark") == F.col("group_mark"))), [signed, reps, labels]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least id of equal word sequence), group_id (least id of the component), kept, group_mark.

    ``group_mark``, a hash of the representative's text, tells components of equal group_id apart: those of several texts of one id, or without an id."""
    return _decided(docs, id_col, text_col, similarity)[0].select("doc_id", "class_id", "group_id", "kept", "group_mark")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that represent their group, with all columns of ``docs``."""
    decided, held = _decided(docs, id_col, text_col, similarity)
    stay = decided.where("kept").groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "mark").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").isNull() & F.col("lone")).alias("free"))
    stay = settle(stay, "kept")
    discard(*held)
    id_name, mark_name, n_name, free_name, row_name = fresh(docs, "id", "mark", "n", "free", "row")
    doc_id, text = field(id_col).cast("long"), F.coalesce(field(text_col).cast("string"), F.lit(""))
    named = stay.toDF(id_name, mark_name, n_name, free_name)
    out = docs.withColumns({id_name: F.coalesce(doc_id, F.lit(0)), mark_name: _mark(doc_id, text)}).join(named.hint("merge"), [id_name, mark_name])
    if not stay.where("n > 1 AND NOT free").isEmpty():  # of rows that are equal in id and text one stays; rows without an id and without a word all stay
        out = out.withColumn(row_name, F.when(F.col(free_name), F.monotonically_increasing_id())).dropDuplicates([id_name, mark_name, row_name])
    return out.select(*[field(c) for c in docs.columns])
