"""Ranked lexical search over norm buckets: long impact vectors first, Cauchy-Schwarz skips buckets, coordinates bound what is left, survivors are scored in integers.

Terms are runs of ASCII letters and digits and of other characters outside ASCII, with A-Z lower-cased. With N documents that hold a term, L terms in all of
them, n in a document, df documents that hold a term and tf its occurrences in one: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document is
(1000000000 tf) div (1000 tf + 8 m), m = 100 - 75 + (75 n N) div L, and a document scores the sum of w times impact over the query's terms, repeats included.

1. One pass over the texts keeps each document's length and the counts of the terms that any query of the block asks for; from it come N, L and df.
2. A document's vector has coordinates sqrt(w) * impact, a query's sqrt(w) * repeats, so their product is the score. Vectors are dealt out by ranges of their norm and written in
   falling order: each stretch of a file is a bucket of vectors of like norm, and Parquet's own bounds let a scan skip the short ones.
3. Buckets are searched in rounds, the longest vectors first. A round hands the next one each query's k-th best score so far, its threshold. No vector with norm below the least threshold / |query| is read;
   a task skips the queries for which |query| * (largest norm of the bucket) is below their threshold; of the rest it adds up a few of the query's largest coordinates and bounds the
   remainder by the norms of what is left; and only documents whose bound reaches the threshold are scored, exactly, in 64-bit integers.

Bounds are from above, so nothing is lost, however weak a threshold is. Queries are taken in blocks of a checked size, one search for each block. Each task hands on k rows a query.

Cases: null and empty texts, and texts without a term, are no documents (they count nowhere) and, as queries, find nothing. Repeated documents count and rank as often as they stand; repeated
queries are each ranked on their own. A document or query without an id keeps a null id and loses ties. Documents that score 0 are not returned. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from marginalia.llm.util import discard, numbered, settle

BLOCK_BYTES = 1 << 20  # text of the queries searched at once
CELLS = 1 << 22  # numbers in a bucket's table of impacts
FOCUS = (4, 8)  # coordinates added up before the bound is taken, step by step
ROUNDS = (1 / 64, 1 / 8, 1.0)  # share of the vectors searched after each round
HITS = "query long, item_id long, doc_id long, score long"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TABLE).split()


class Block:
    """Queries searched together: their ids and the terms they ask for, with repeats."""

    def __init__(self, items: list[tuple[int, int | None, str]]):
        self.rows, self.ids = [i for i, _, _ in items], [i for _, i, _ in items]
        asked = [Counter(terms(t.encode("utf-8", "replace"))) for _, _, t in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for q in asked for t in q}))}
        self.terms = [np.array([self.vocabulary[t] for t in q], np.int64) for q in asked]
        self.repeats = [np.array(list(q.values()), np.int64) for q in asked]

    def weigh(self, n: int, df: dict[int, int]) -> None:
        """Term weights from the corpus; queries as vectors, their largest coordinates first."""
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        for t, d in df.items():
            self.weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1)))
        self.root = np.sqrt(self.weights.astype(np.float64))
        self.focus, self.gains, self.coordinates, self.norms = [], [], [], np.zeros(len(self.terms))
        for i, (t, r) in enumerate(zip(self.terms, self.repeats, strict=True)):
            x = self.root[t] * r
            order = np.argsort(-x, kind="stable")
            order = order[x[order] > 0]
            self.focus.append(t[order])
            self.coordinates.append(x[order])
            self.gains.append((self.weights[t] * r)[order])
            self.norms[i] = math.sqrt(float(x @ x))


def _counts(block: Block):
    """Per document with a term: doc_id, n, and of the block's terms their numbers and occurrences."""
    known = block.vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, at, found, tf = [], [], [0], [], []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms(text.as_py() or b"")
                if words:
                    ids.append(i.as_py())
                    sizes.append(len(words))
                    own = Counter(words)
                    hits = own.keys() & known.keys()
                    found += [known[t] for t in hits]
                    tf += [own[t] for t in hits]
                    at.append(len(found))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, tf)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], schema=schema)

    return count


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of lists."""
    lengths = np.diff(np.asarray(column.offsets))
    return np.asarray(column.flatten()), lengths


def _vectors(weights: np.ndarray, n_docs: int, n_terms: int):
    """doc_id, row, norm, and the impacts of terms of a positive weight; documents without one are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("norm", pa.float64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = _flat(batch.column("terms"))
            tf, _ = _flat(batch.column("tf"))
            tf, doc = tf.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
            m = 100 - 75 + (75 * np.asarray(batch.column("n")) * n_docs) // n_terms
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            good = (weights[found] > 0) & (impacts > 0)
            found, impacts, doc = found[good], impacts[good], doc[good]
            norm = np.sqrt(np.bincount(doc, weights[found] * impacts.astype(np.float64) ** 2, minlength=len(lengths)))
            at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(lengths)))))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (impacts, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(norm), *lists], schema=schema)
            yield out.filter(pa.array(norm > 0))

    return build


class Best:
    """The k best documents of a query seen so far: highest score, then known and smallest id."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.score, self.lost, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, lost: np.ndarray, doc: np.ndarray) -> None:
        score, lost, doc = np.concatenate((self.score, score)), np.concatenate((self.lost, lost)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, lost, -score))[: self.k]
        self.score, self.lost, self.doc = score[order], lost[order], doc[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def survivors(block: Block, i: int, table: np.ndarray, norms: np.ndarray, least: int, focus: tuple[int, ...] = FOCUS) -> np.ndarray:
    """Places in a bucket whose bound reaches ``least`` for query ``i``: the product over some coordinates, and the norms of what is left."""
    slack = 1 + 1e-9
    places = np.flatnonzero(block.norms[i] * norms * slack >= least)
    sure, rest, own, done = np.zeros(len(places)), norms[places] ** 2, block.norms[i] ** 2, 0
    for upto in focus:
        if not len(places) or done >= len(block.focus[i]):
            break
        for t, q in zip(block.focus[i][done:upto], block.coordinates[i][done:upto], strict=True):
            d = table[t, places] * block.root[t]
            sure += q * d
            rest -= d * d
            own -= q * q
        done = upto
        good = (sure + math.sqrt(max(own, 0.0)) * np.sqrt(np.maximum(rest, norms[places] ** 2 * 1e-12))) * slack + 1 >= least
        places, sure, rest = places[good], sure[good], rest[good]
    return places


def _search(block: Block, k: int, least: list[int]):
    """The k best of a task for each query, in the order of the rows it reads."""
    schema = pa.schema([(c, pa.int64()) for c in ("query", "item_id", "doc_id", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        width = max(len(block.vocabulary), 1)
        step = max(16, CELLS // width)
        for batch in batches:
            for start in range(0, len(batch), step):
                bucket = batch.slice(start, step)
                found, lengths = _flat(bucket.column("terms"))
                impacts, _ = _flat(bucket.column("impacts"))
                norms = np.asarray(bucket.column("norm"))
                table = np.zeros((width, len(bucket)), np.int64)
                table[found, np.repeat(np.arange(len(bucket)), lengths)] = impacts
                ids = bucket.column("doc_id")
                lost, docs = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                longest = norms.max(initial=0.0)
                for i, own in enumerate(best):
                    if block.norms[i] * longest * (1 + 1e-9) < own.least:
                        continue
                    places = survivors(block, i, table, norms, own.least)
                    if len(places):
                        score = block.gains[i] @ table[np.ix_(block.focus[i], places)]
                        good = score >= own.least
                        if good.any():
                            own.add(score[good], lost[places[good]], docs[places[good]])
        for row, item, own in zip(block.rows, block.ids, best, strict=True):
            n = len(own.score)
            if n:
                columns = [pa.array([row] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(own.doc, pa.int64(), mask=own.lost), pa.array(own.score, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return search


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(block: Block, docs: DataFrame, k: int, rounds: tuple[float, ...]) -> DataFrame | None:
    counted = settle(docs.mapInArrow(_counts(block), "doc_id long, n long, terms array<int>, tf array<int>").withColumn("row", F.monotonically_increasing_id()), "counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = {r["t"]: r["n"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a term of the block
    block.weigh(n_docs, df)
    vectors = counted.mapInArrow(_vectors(block.weights, n_docs, n_terms), "doc_id long, row long, norm double, terms array<int>, impacts array<long>")
    dealt = settle(vectors.repartitionByRange(F.col("norm").desc(), F.xxhash64("row")).sortWithinPartitions(F.col("norm").desc()), "vectors")
    discard(counted)
    cuts = dealt.agg(F.percentile_approx("norm", [1 - r for r in rounds], 1000)).first()[0]
    if cuts is None:
        return None
    least, hits, above = [1] * len(block.rows), None, math.inf
    place = {row: i for i, row in enumerate(block.rows)}
    for share, cut in zip(rounds, cuts, strict=True):
        last = share == rounds[-1]
        reach = min((x / n for x, n in zip(least, block.norms, strict=True) if n > 0), default=math.inf) * (1 - 1e-9)
        part = dealt.where((F.col("norm") < above) & (F.col("norm") >= (reach if last else max(cut, reach))))
        found = part.mapInArrow(_search(block, k, least), HITS)
        found = settle(_ranked(found if hits is None else found.unionByName(hits), k).select("query", "item_id", "doc_id", "score"), "hits")
        hits, above = found, min(above, cut)
        if not last:
            kth = hits.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()  # at most one row a query of the block
            for r in kth:
                least[place[r["query"]]] = r["least"]
    return hits


def search(queries: DataFrame, docs: DataFrame, k: int = 10, item_col: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k best documents of each query with a score above 0."""
    spark = docs.sparkSession
    rows = numbered(queries.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(query_text).cast("string"), F.lit("")).alias("text")), "queries").select("row", "doc.item_id", "doc.text")
    corpus = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    n_blocks = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    found = []
    for b in range(n_blocks):
        own = rows.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b) if n_blocks > 1 else rows
        block = Block([(r["row"], r["item_id"], r["text"]) for r in own.orderBy("row").collect()])  # about block_bytes
        hits = _search_block(block, corpus, k, rounds) if block.vocabulary else None
        if hits is not None:
            found.append(hits)
    out = spark.createDataFrame([], HITS) if not found else found[0]
    for hits in found[1:]:
        out = out.unionByName(hits)
    return _ranked(out, k).select("item_id", "rank", "doc_id", "score")
