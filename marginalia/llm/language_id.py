"""Language identification by a byte convolutional network.

A text is cut in windows of 256 bytes, the last one padded, so whole texts are read at a fixed cost a byte. Filters of widths 2, 3 and
4 over the bytes' classes, the maximum of each over the window, and a softmax layer give the window's probabilities; a text's are the
windows' mean log-probabilities, weighted by their letters. The network is trained in numpy, by Adam, on windows of
a bounded sample of labelled rows (``sample`` documents in hash order, ``sample_chars`` characters from a place of each); these are parameters and bound the fit alone.
A filter of width 3 or 4 is applied as a sum over pairs of bytes from a table made of its weights.

Cases: a null text, or one without letters, is ``und`` with score 0; so is every text if no row is labelled. With one label only, every text with letters gets it.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marginalia.llm import words as wd
from marginalia.llm.util import crc32_mod, hash_sample

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
SAMPLE, SAMPLE_CHARS = 4_000, 600
UNKNOWN = "und"
RESULT = "struct<lang: string, score: double>"

#: Classes of bytes: 0 pad, letters by lower case, digits, white space, other ASCII, and each byte from 128 on
_CLASS = np.full(256, 29, np.int64)
_CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 27, 28
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(30, 158)
CLASSES = 158
_LETTER = (_CLASS >= 1) & (_CLASS <= 26) | (_CLASS >= 30)


def _windows(buf: np.ndarray, offs: np.ndarray):
    """Classes by window, the text of each window, its count of letters."""
    n = -(-np.diff(offs) // WINDOW)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) * WINDOW if len(ends) else 0, np.int64)
    letters = np.zeros(len(out), bool)
    kinds, is_letter = _CLASS[buf], _LETTER[buf]
    for a, b, w in zip(offs[:-1].tolist(), offs[1:].tolist(), ((ends - n) * WINDOW).tolist()):
        out[w : w + b - a] = kinds[a:b]
        letters[w : w + b - a] = is_letter[a:b]
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(n)), n), letters.reshape(-1, WINDOW).sum(1)


class Network:
    def __init__(self, langs: list[str], filters: list[np.ndarray], bias: np.ndarray, top: np.ndarray, top_bias: np.ndarray):
        self.langs, self.filters, self.bias, self.top, self.top_bias = langs, filters, bias, top, top_bias
        self.pairs = []  # per width: tables [filter, pair of classes], at which offsets
        for width, w in zip(WIDTHS, filters):
            tables = []
            for j in range(0, width - 1, 2):
                tables.append((j, (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(-1, FILTERS).T.astype(np.float32).copy()))
            if width % 2:
                tables.append((width - 1, w[width - 1].T.astype(np.float32).copy()))
            self.pairs.append((width, tables))

    def features(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        for lo in range(0, len(windows), 256):
            x = windows[lo : lo + 256]
            pair = np.zeros_like(x)
            pair[:, :-1] = x[:, :-1] * CLASSES + x[:, 1:]
            k = 0
            for width, tables in self.pairs:
                for f in range(FILTERS):
                    total = None
                    for j, table in tables:
                        source = pair if table.shape[1] > CLASSES else x
                        part = table[f].take(source)[:, j : WINDOW - width + 1 + j]
                        total = part if total is None else total + part
                    out[lo : lo + 256, k] = total.max(1)
                    k += 1
        return np.maximum(out + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.top + self.top_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    @classmethod
    def fit(cls, langs: list[str], windows: np.ndarray, kinds: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        values = [rng.normal(0, 0.1, (w, CLASSES, FILTERS)) for w in WIDTHS]
        values += [np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs))]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        steps = epochs * max(1, -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                x, n, step = windows[rows], len(rows), step + 1
                peaks, places = [], []
                for width, w in zip(WIDTHS, values):
                    total = sum(w[j][x[:, j : WINDOW - width + 1 + j]] for j in range(width))
                    places.append(total.argmax(1))
                    peaks.append(total.max(1))
                pre = np.concatenate(peaks, 1) + values[-3]
                hidden = np.maximum(pre, 0)
                z = hidden @ values[-2] + values[-1]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), kinds[rows]] -= 1
                p /= n
                back = (p @ values[-2].T) * (pre > 0)
                slopes = [np.zeros_like(v) for v in values]
                for k, width in enumerate(WIDTHS):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        np.add.at(slopes[k][j], (x[np.arange(n)[:, None], places[k] + j], np.arange(FILTERS)[None, :]), part)
                slopes[-3], slopes[-2], slopes[-1] = back.sum(0), hidden.T @ p + 1e-4 * values[-2], p.sum(0)
                pace = rate * (1 - 0.9 * step / steps)
                for value, slope, m, s in zip(values, slopes, first, second):
                    m += 0.1 * (slope - m)
                    s += 0.01 * (slope**2 - s)
                    value -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return cls(langs, values[:-3], values[-3].astype(np.float32), values[-2].astype(np.float32), values[-1].astype(np.float32))

    def predict(self, column: pa.Array) -> pa.Array:
        langs, scores = np.full(len(column), -1), np.zeros(len(column))
        for a, b, buf, offs in wd.text_slices(column):
            windows, doc, letters = _windows(buf, offs)
            if not len(windows):
                continue
            logs = self.log_probabilities(windows)
            weight = np.bincount(doc, weights=letters, minlength=b - a)
            mean = np.stack([np.bincount(doc, weights=logs[:, k] * letters, minlength=b - a) for k in range(len(self.langs))], 1) / np.maximum(weight, 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            ascii_letters = np.add.reduceat(np.append((_CLASS[buf] >= 1) & (_CLASS[buf] <= 26), False).astype(np.int64), np.minimum(offs[:-1], len(buf))) * (np.diff(offs) > 0)
            has = ascii_letters > 0
            for i in np.flatnonzero((weight > 0) & ~has):  # other scripts, or marks and symbols
                has[i] = any(c.isalpha() for c in column[int(a + i)].as_py())
            langs[a:b] = np.where(has, p.argmax(1), -1)
            scores[a:b] = np.where(has, p.max(1), 0)
        return pa.StructArray.from_arrays([pa.array([UNKNOWN if k < 0 else self.langs[k] for k in langs.tolist()], pa.string()), pa.array(scores)], ["lang", "score"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, hold: int = 2, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Network | None:
    """Train on documents outside fold ``hold``: up to ``sample_chars`` characters from a hash-random place of each sampled text."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    rows = rows.where(F.coalesce(crc32_mod("id", folds), F.lit(0)) != hold)
    total = rows.count()
    start = (F.pmod(F.xxhash64(F.lit(12), "id"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1).cast("int")
    parts = rows.where("length(text) > 0").select("id", "lang", F.col("text").substr(start, F.lit(sample_chars)).alias("text"))
    found = hash_sample(parts, "id", sample, total).collect()
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return None
    ((_, _, buf, offs),) = wd.text_slices(pa.array([r["text"] for r in found], pa.string()), 1 << 62)
    windows, doc, letters = _windows(buf, offs)
    kinds = np.array([langs.index(r["lang"]) for r in found])[doc]
    good = letters >= 8
    if not good.any():
        good[:] = True
    return Network.fit(langs, windows[good], kinds[good])


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, hold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    network = fit(docs, id_col, text_col, lang_col, folds, hold)
    head = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc32_mod(id_col, folds) == hold, F.lit(False)).alias("held_out")]
    if network is None:
        return docs.select(*head, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf(RESULT)
    def predict(text: pa.Array) -> pa.Array:
        return shared.value.predict(text)

    rows = docs.select(*head, predict(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
