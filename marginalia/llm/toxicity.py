"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and their beginnings of 4, 5 and 6 bytes, hashed to 28 bits. The machine scores the terms present in a text: a weight
for each, and for each pair the product of their factors, so that two terms can mean more together than apart. It is trained on a
bounded sample of labelled documents (``sample`` rows, in hash order). Its terms are the ``features`` terms that tell the classes apart best by a likelihood-ratio test, and
those of the ``pairs`` pairs, among the ``candidates`` terms of most documents (of terms that stand in the same documents, one), that tell them apart best beyond what each term does alone. These are parameters and bound the fit alone:
terms are counted by Spark, only the chosen ones of each sampled document reach the driver, and every whole text is scored.

Cases: a null or empty text gets the score of a text without terms; documents without a label are scored like others; labels
other than 0 and 1, null labels and labels of unknown documents are not used; a document labelled twice uses its higher label, as do documents of the same terms, which count once; with no
label of one class the score is the (smoothed) share of label 1. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm import words as wd
from marginalia.llm.util import crc32_mod, hash_sample, settle

HEADS = (4, 5, 6)
TERM_BITS, FACTORS = 28, 4
SAMPLE, FEATURES, CANDIDATES, PAIRS = 6_000, 400, 4_000, 100
LEAST_RATIO, LEAST_DOCS = 15.0, 4  # a term's or pair's likelihood ratio (a pair's beyond the chance of its being one of many), and its documents
REJECT = 0.7


def _terms(buf: np.ndarray, offs: np.ndarray):
    """Hashed terms of a run of texts, each with its text."""
    if len(buf):  # lower-case the capitals of Latin-1 too: their second byte in UTF-8
        buf = buf.copy()
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[1:][capital] += 0x20
    h, _, _, first, *heads = wd.words(buf, offs, heads=HEADS)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    every = [(h, doc)] + [(x[x != 0], doc[x != 0]) for x in heads]
    return [((x >> np.uint64(64 - TERM_BITS)).astype(np.int64), d) for x, d in every]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, distinct terms, a hash of them)."""
    for batch in batches:
        for a, b, buf, offs in wd.text_slices(batch.column(1)):
            term, doc = (np.concatenate(x) for x in zip(*_terms(buf, offs)))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(b - a + 1))
            lists = [np.unique(term[order[i:j]]).astype(np.int32) for i, j in zip(cut[:-1], cut[1:])]
            marks = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in lists]
            yield pa.RecordBatch.from_pydict({"label": batch.column(0).slice(a, b - a), "terms": pa.array(lists, pa.list_(pa.int32())), "mark": pa.array(marks, pa.int64())})


def _ratio(k, k1, n: int, n1: int):
    """Likelihood ratio of labels within and outside of a term's documents, by numpy or by columns."""
    log = F.log if isinstance(k, Column) else np.log
    k0 = k - k1
    p, p1, p0 = (k + 1e-9) / (n + 2e-9), (k1 + 0.5) / (n1 + 1), (k0 + 0.5) / (n - n1 + 1)
    return 2 * (k1 * log(p1 / p) + (n1 - k1) * log((1 - p1) / (1 - p)) + k0 * log(p0 / p) + (n - n1 - k0) * log((1 - p0) / (1 - p)))


def _different(docs: list[np.ndarray], term: np.ndarray) -> np.ndarray:
    """The first of the terms (sorted) of each set that stand in the same documents, by sums of random numbers of documents: a word and its beginnings are often one such set."""
    of_doc = np.random.default_rng(3).integers(0, 1 << 62, len(docs), np.uint64)
    sums = np.zeros(len(term), np.uint64)
    for d, x in zip(docs, of_doc):
        at = np.minimum(np.searchsorted(term, d), len(term) - 1)
        sums[at[term[at] == d]] += x
    return np.unique(sums, return_index=True)[1]


def _paired(x: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """Terms (columns of x) of the pairs that tell the labels apart best beyond what each term does alone."""
    n, n1, m = len(labels), labels.sum(), x.shape[1]
    if m < 2:
        return np.zeros(0, np.int64)
    positive = x[labels == 1]
    k, k1 = x.sum(0).astype(np.float64), positive.sum(0).astype(np.float64)

    def information(c, p):
        """Of cells of c documents, p of them of label 1."""
        q = c - p
        with np.errstate(divide="ignore", invalid="ignore"):
            return 2 * (np.where(p > 0, p * np.log(p * n / (c * n1)), 0.0) + np.where(q > 0, q * np.log(q * n / (c * (n - n1))), 0.0))

    alone = information(k, k1) + information(n - k, n1 - k1)
    found = []
    for a in range(0, m, 64):
        b = min(m, a + 64)
        both, both1 = (x[:, a:b].T @ x).astype(np.float64), (positive[:, a:b].T @ positive).astype(np.float64)
        ka, k1a = k[a:b, None], k1[a:b, None]
        gain = information(both, both1) + information(ka - both, k1a - both1) + information(k - both, k1 - both1) + information(n - ka - k + both, n1 - k1a - k1 + both1) - alone[a:b, None] - alone
        gain[np.arange(a, b)[:, None] >= np.arange(m)] = 0
        i, j = np.nonzero(gain > LEAST_RATIO + 2 * np.log(m * m / 2))
        found += zip((-gain[i, j]).tolist(), (i + a).tolist(), j.tolist())
    return np.unique([[i, j] for _, i, j in sorted(found)[:most]]).astype(np.int64)


class Machine:
    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.gate = np.zeros(1 << 20, bool)
        self.gate[terms >> (TERM_BITS - 20)] = True

    @classmethod
    def fit(cls, labels: np.ndarray, docs: list[np.ndarray], features: int = FEATURES, candidates: int = CANDIDATES, pairs: int = PAIRS, steps: int = 600, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
        n, n1 = len(labels), int(labels.sum())
        share = (n1 + 1) / (n + 2)
        constant = cls(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
        if n1 in (0, n) or not sum(map(len, docs)):
            return constant
        every = np.concatenate(docs)
        every.sort()
        at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        term, k = every[at], np.diff(np.append(at, len(every)))
        del every
        enough = k >= LEAST_DOCS
        term, k = term[enough], k[enough].astype(np.float64)
        if not len(term):
            return constant
        k1 = np.zeros(len(term))
        for d in (docs[i] for i in np.flatnonzero(labels)):
            place = np.minimum(np.searchsorted(term, d), len(term) - 1)
            k1[place[term[place] == d]] += 1
        def present(chosen: np.ndarray) -> np.ndarray:
            x = np.zeros((n, len(chosen)), np.float32)
            for i, d in enumerate(docs):
                place = np.minimum(np.searchsorted(chosen, d), len(chosen) - 1)
                x[i, place[chosen[place] == d]] = 1
            return x

        ratio = _ratio(k, k1, n, n1)
        best = np.lexsort((term, -ratio))[:features]
        best = best[ratio[best] >= LEAST_RATIO]
        one = _different(docs, term)
        often = np.sort(one[np.lexsort((term[one], -k[one]))[:candidates]])
        best = np.union1d(best, often[_paired(present(term[often]), labels, pairs)] if n > 1 else best).astype(np.int64)
        if not len(best):
            return constant
        chosen = term[best].astype(np.int64)
        x = present(chosen)
        rng = np.random.default_rng(seed)
        labels = labels.astype(np.float32)
        values = [np.array([constant.bias], np.float32), np.zeros(len(best), np.float32), rng.normal(0, 0.05, (len(best), FACTORS)).astype(np.float32)]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, steps + 1):
            b, w, v = values
            xv = x @ v
            score = b + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) / n
            slopes = [np.array([error.sum()]), x.T @ error + decay * w / len(best), x.T @ (error[:, None] * xv) - (x.T @ error)[:, None] * v + decay * v / len(best)]
            for value, slope, m, s in zip(values, slopes, first, second):  # Adam
                m += 0.1 * (slope - m)
                s += 0.01 * (slope**2 - s)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        b, w, v = values
        return cls(chosen, float(b[0]), w.astype(np.float64), v.astype(np.float64))

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for a, b, buf, offs in wd.text_slices(column):
            if not len(self.terms):
                continue
            pairs = []
            for term, doc in _terms(buf, offs):
                near = self.gate[term >> (TERM_BITS - 20)]
                term, doc = term[near], doc[near]
                at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
                real = self.terms[at] == term
                pairs.append(doc[real] * len(self.terms) + at[real])
            doc, at = np.divmod(np.unique(np.concatenate(pairs)), len(self.terms))
            linear = np.bincount(doc, weights=self.weights[at], minlength=b - a)
            for f in self.factors.T:
                total = np.bincount(doc, weights=f[at], minlength=b - a)
                linear += 0.5 * (total**2 - np.bincount(doc, weights=f[at] ** 2, minlength=b - a))
            out[a:b] += linear
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _only(chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x[np.isin(x, chosen.value)] for x in (np.asarray(v.values) for v in batch.column(1))]
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "terms": pa.array(lists, pa.list_(pa.int32()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, hold: int = 1, sample: int = SAMPLE, features: int = FEATURES, candidates: int = CANDIDATES, pairs: int = PAIRS) -> Machine:
    """Train on documents outside fold ``hold``."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.where(crc32_mod("id", folds) != hold).groupBy("id").agg(F.max("label").alias("label"))
    known = hash_sample(known, "id", sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = rows.join(F.broadcast(known), "id").select("label", "text").mapInArrow(_features, "label int, terms array<int>, mark long")
    found = settle(found.groupBy("mark").agg(F.max("label").alias("label"), F.first("terms").alias("terms")), "terms")
    n, n1 = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    stands = F.bit_xor(F.xxhash64("mark")).alias("stands")  # in the same documents: the same number
    counts = settle(found.select("label", "mark", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.sum("label").alias("k1"), stands).where(F.col("k") >= LEAST_DOCS), "counts")
    often = counts.groupBy("k", "stands").agg(F.min("term").alias("term"))
    chosen = counts.orderBy(F.desc(_ratio(F.col("k"), F.col("k1"), n, n1)), "term").limit(features).select("term").unionByName(often.orderBy(F.desc("k"), "term").limit(candidates).select("term")).distinct()
    chosen = docs.sparkSession.sparkContext.broadcast(np.array([r["term"] for r in chosen.collect()], np.int32))  # at most features + candidates
    found = found.select("label", "terms").mapInArrow(_only(chosen), "label int, terms array<int>").toArrow()  # at most sample rows of these terms
    kinds, lists = found.column("label").to_numpy(), pa.concat_arrays(found.column("terms").chunks) if len(found) else pa.array([], pa.list_(pa.int32()))
    flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    terms = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    order = sorted(range(len(kinds)), key=lambda i: (kinds[i], terms[i].astype(">i4").tobytes()))  # the fit is the same in whatever order rows come
    return Machine.fit(kinds[order].astype(np.float64), [terms[i] for i in order], features, candidates, pairs)


def scorer(machine: Machine, spark):
    """A function from a text column to the column of scores."""
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    def scores(text: Column) -> Column:
        return score(F.coalesce(text.cast("string"), F.lit("")))

    return scores


def annotate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, hold: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scores = scorer(fit(docs, labels, id_col, text_col, folds=folds, hold=hold), docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc32_mod(id_col, folds) == hold, F.lit(False)).alias("held_out"), scores(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose score is below REJECT, with all their columns."""
    return docs.where(scorer(fit(docs, labels, text_col=text_col, **options), docs.sparkSession)(docs[text_col]) < REJECT)
