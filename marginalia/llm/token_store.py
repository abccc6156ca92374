"""Token-id files: whole texts as ids of a public tokenizer, in ascending order of document, range-coded.

Format of a segment (one binary value; the files are Parquet tables of segments, so that Spark reads and writes them in any store):

    magic "MTS2", then little-endian: n_docs u32, n_ids u64, block length u32, lengths of the two tables u32 each
    zlib-compressed document table: doc_id i64 each (the least i64 stands for null), then n_tokens u64 each
    zlib-compressed block table: code length u32 each, then CRC-32 u32 each
    the vocabulary (its size and length u32 each, then zlib-compressed ids and counts), and the blocks' codes (see range_coder)

Documents are dealt by ranges of doc_id and sorted within a range; a range's documents fill segments of whole documents. Offsets are sums over
segments. The ids of a word (a run without ASCII white space, which this tokenizer's pre-tokenizer never joins across) are looked up once in
a worker and reused, by the word's bytes; the tokenizer library encodes every different word.

Cases: a null or empty text has only the end id; a null doc_id sorts first; repeated rows are stored each; an empty table gives an empty
folder table; strings of special tokens inside a text get their ids, as the library gives them by default.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from marginalia.llm import range_coder, words as wd
from marginalia.llm.util import new_folder, texts

MAGIC, HEAD = b"MTS2", struct.Struct("<IQIII")
SEGMENT_IDS, RANGE_BYTES, SLICE_BYTES = 4 << 20, 10 << 20, 12 << 20  # words are told apart a slice: mostly a whole range
NULL_ID = -(1 << 63)
_MARKS = np.isin(np.arange(256), list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{}~'))  # not the apostrophe of 's, nor the bar of <|endoftext|>
SEGMENT_SCHEMA = "part int, segment int, n_docs long, n_ids long, data binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of many texts, word by word, with the words seen so far. Words are told apart by their bytes, less the case of A-Z, which this tokenizer folds.

    Words are cut where it always cuts them, between an ASCII letter and one of ``_MARKS``. Many new words go to the library as one line; the bytes of the
    tokens tell where each word ends, and a line where they do not (words that the library normalises) is encoded word by word. Lines of ASCII, which hold
    neither A-Z nor white space but single blanks, are as the library would normalise them, so it need not."""

    MOST, LINE = 1_000_000, 256  # words kept, words in a line

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same model, without the normalizer
        self.plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # a character of a token stands for a byte
            self.n_bytes[i] = len(token.removesuffix(suffix)) if suffix else len(token)
        self.added = sorted({t.content[:2].encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, lines: list[bytes]) -> list[np.ndarray]:
        known = all(x.isascii() and not any(a in x for a in self.added) for x in lines)  # in lower case and normal form
        return [np.frombuffer(array("I", e.ids), np.uint32) for e in (self.plain if known else self.tokenizer).encode_batch_fast([x.decode("utf-8", "replace") for x in lines], add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids, and how many each word has."""
        ids, counts = [], np.zeros(len(words), np.int64)
        lines = [slice(k, k + self.LINE) for k in range(0, len(words), self.LINE)]
        for k in range(0, len(lines), 4):  # the library's results are large
            some = lines[k : k + 4]
            bodies = [b" ".join(words[x]) for x in some]
            for part, body, found in zip(some, bodies, self._ids(bodies)):
                own = words[part]
                upto, ends = np.cumsum(self.n_bytes[found]), np.cumsum([len(w) for w in own])
                last = np.searchsorted(upto, ends)
                if len(found) and last[-1] == len(found) - 1 and (upto[last] == ends).all() and not any(x in body for x in self.added):
                    last[1:] -= last[:-1].copy()
                    last[0] += 1
                    counts[part] = last
                    ids.append(found)
                else:
                    single = self._ids(own)
                    counts[part] = [len(x) for x in single]
                    ids += single
        return ids, counts

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, with new ones encoded."""
        if len(self.known) > self.MOST:
            self._forget()
        places = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(places < 0)
        if len(at):
            at = at[np.argsort([words[i].isascii() for i in at.tolist()], kind="stable")]  # words that the library may normalise share their lines
            new = [words[i] for i in at.tolist()]
            ids, length = self._encode(new)
            places[at] = np.arange(len(self.length), len(self.length) + len(new))
            self.known.update(zip(new, range(len(self.length), len(self.length) + len(new))))
            self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(length) - length))
            self.length, self.pool = np.concatenate((self.length, length)), np.concatenate((self.pool, *ids))
        return places

    def __call__(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts, each with the end id, and their counts."""
        n_docs = len(offs) - 1
        body, sizes, first = wd.spans(buf, offs, wd.NOT_BLANK, wd.LETTER, _MARKS)
        if not len(sizes):
            return np.full(n_docs, end_id, np.uint32), np.ones(n_docs, np.int64)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        plain, body = body, wd.look(wd.LOWER, body)
        for a, b in self.added:  # an added token is told by case
            at = np.searchsorted(ends, np.flatnonzero((body[:-1] == a) & (body[1:] == b)), "right") - 1
            body = body.copy() if len(at) else body
            for i, j in zip(ends[at].tolist(), ends[at + 1].tolist()):
                body[i:j] = plain[i:j]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
        places = self._places(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = self.length[places]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(length), np.zeros(1, np.int64)))
        ends[-1] = ends[-2] + 1  # after the different words, the end id
        pool = np.append(self.pool.take(np.repeat(self.begin[places] - ends[:-2], length) + np.arange(ends[-2])), np.uint32(end_id))
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) + 1, [None, pa.py_buffer(4 * ends), pa.py_buffer(pool)])
        found = table.take(pa.array(np.insert(words.indices.to_numpy(), first[1:], len(places))))
        ends = np.frombuffer(found.buffers()[1], np.int64)[first[1:] + np.arange(1, n_docs + 1)] // 4
        return np.frombuffer(found.buffers()[2], np.uint32, ends[-1]), np.diff(ends, prepend=0)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder: later tasks of a worker know the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    length, vocabulary = range_coder.block_length(len(ids)), range_coder.Vocabulary.of(ids)
    codes, checks = range_coder.encode(ids, length, vocabulary)
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes())
    blocks = zlib.compress(np.array([len(c) for c in codes] + checks, "<u4").tobytes())
    return MAGIC + HEAD.pack(len(doc_ids), len(ids), length, len(docs), len(blocks)) + docs + blocks + vocabulary.pack() + b"".join(codes)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a segment; ValueError if it is damaged."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    try:
        return _unpack(data)
    except (zlib.error, struct.error, IndexError) as error:
        raise ValueError("damaged segment") from error


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_docs, n_ids, length, n_doc_table, n_block_table = HEAD.unpack_from(data, 4)
    at = 4 + HEAD.size
    table = zlib.decompress(data[at : at + n_doc_table])
    doc_ids, counts = np.frombuffer(table, "<i8", n_docs), np.frombuffer(table, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    at += n_doc_table
    table = np.frombuffer(zlib.decompress(data[at : at + n_block_table]), "<u4")
    at += n_block_table
    vocabulary, size = range_coder.Vocabulary.unpack(data[at:])
    n = len(table) // 2
    ends = at + size + np.cumsum(table[:n].astype(np.int64))
    codes = [data[e - s : e] for e, s in zip(ends.tolist(), table[:n].tolist())]
    return doc_ids, counts, range_coder.decode(codes, table[n:].tolist(), n_ids, length, vocabulary)


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n, segment = _encoder(path), [], 0, 0

        def row() -> pa.RecordBatch:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            data = pack(doc_ids, counts, ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "data": pa.array([data], pa.binary())})

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else 0
            doc_ids = batch.column(1).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for a, b, buf, offs in wd.text_slices(batch.column(2), SLICE_BYTES):
                ids, counts = encoder(buf, offs, end_id)
                held.append((doc_ids[a:b], counts, ids))
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield row()
                    held, n, segment = [], 0, segment + 1
        if held:
            yield row()

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their segments in ``folder``."""
    rows = texts(docs, id_col, text_col)
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranged = rows.repartitionByRange(int(n_bytes // RANGE_BYTES) + 1, "doc_id").sortWithinPartitions("doc_id")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ranged.mapInArrow(_segments(path or tokenizer_path(), end_id), SEGMENT_SCHEMA).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, segment, data in zip(*(batch.column(k) for k in range(3))):
            doc_ids, counts, ids = unpack(data.as_py())
            ends = np.cumsum(counts)
            plain = ids.astype("<u4")
            crc = [zlib.crc32(plain[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
            n = len(doc_ids)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part.as_py()] * n, pa.int32()), "segment": pa.array([segment.as_py()] * n, pa.int32()), "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID),
                "inner": pa.array(ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64()),
            })


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    sizes = table.select("part", "segment", "n_ids", F.floor(F.col("part") / 1024).alias("run"))
    runs = sizes.groupBy("run").agg(F.sum("n_ids").alias("n")).select("run", F.coalesce(F.sum("n").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("run_start"))
    own = W.partitionBy("run").orderBy("part", "segment").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(runs, "run").select("part", "segment", (F.col("run_start") + F.col("before")).alias("segment_start"))
    rows = table.select("part", "segment", "data").mapInArrow(_documents, "part int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            doc_ids, counts, ids = unpack(data.as_py())
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64())
            lists = pa.LargeListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            for lo in range(0, len(doc_ids), 256):
                part = lists.slice(lo, 256).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo : lo + 256], pa.int64(), mask=doc_ids[lo : lo + 256] == NULL_ID), part], ["doc_id", "ids"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: doc_id, ids."""
    return spark.read.schema(SEGMENT_SCHEMA).parquet(folder).select("data").mapInArrow(_ids, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    write(docs, folder, path, **options)
    return read(docs.sparkSession, folder)
