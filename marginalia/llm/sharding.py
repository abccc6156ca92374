"""Sharding by extendible hashing.

A document's place is a 60-bit hash; the directory is indexed by its leading bits. A bucket that exceeds the byte limit splits
on the next bit, other buckets keep their depth, until every shard fits. The directory grows by ``STRIDE`` bits a step: sizes are summed by the
leading bits (in the tasks first, so one small row for each occupied cell and task), the least depth that fits is found for each cell, and only rows of buckets that are still too
large go on to the next step; steps end where most buckets fit, then take three bits. Rows of one id share the leading 40 bits, and the last 20 bits differ by row, so even a repeated id can split.

Cases: a null text has 0 bytes; a document larger than the limit has a shard of its own; a null id is hashed as an empty string; an
empty table gives an empty table; a limit that holds all bytes gives one shard of depth 0; rows that agree in all 60 bits stay together.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.util import discard, field, numbered, settle

LIMIT = 1 << 20
BITS, ID_BITS, STRIDE = 60, 40, 8
SMALL = 1_000_000  # rows of a directory step that are broadcast; more are joined by their bits
LEAF = ["depth", "prefix", "shard_bytes", "shard_docs"]


def _place(doc_id: Column, row: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    by_id = F.conv(F.substring(digest, 1, ID_BITS // 4), 16, 10).cast("long")
    return F.shiftleft(by_id, BITS - ID_BITS) + F.pmod(F.xxhash64(row), F.lit(1 << (BITS - ID_BITS)))


def _places(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc) to row, doc_id, hash, bytes."""
    doc_id, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col).cast("string")
    return rows.select("row", doc_id.cast("long").alias("doc_id"), _place(doc_id, F.col("row")).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))


def _split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell (leading ``high`` bits, n_bytes, n_docs) the least depth in low..high at which its bucket fits, and that bucket's totals; a cell that fits at none has no row."""
    at = cells.select("cell", "n_bytes", "n_docs", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = at.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1) | (F.col("depth") == BITS))
    found = at.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
    return found.groupBy("cell").agg(F.min_by(F.struct(*LEAF), "depth").alias("s")).select("cell", "s.*")


def _grow(places: DataFrame, limit: int):
    """The steps of the directory: (rows that were still open, the cell of a row, the cells that this step has settled and their leaves, whether these are broadcast)."""
    total = places.agg(F.sum("bytes")).first()[0] or 0
    enough = math.ceil(math.log2(max(1, total / limit))) + 2  # bits by which most buckets fit: about four cells a shard, however large the corpus
    low, rows = 0, places
    while True:
        high = min(BITS, low + STRIDE, enough if low <= enough else low + 2)
        cell = F.shiftright("hash", BITS - high)
        cells = settle(rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs")), "cells")
        found = settle(_split(cells, low, high, limit), "directory")
        small = cells.count() <= SMALL
        if found.count():
            yield rows, cell, F.broadcast(found) if small else found, small
        left = settle(cells.join(found, "cell", "left_anti").select("cell"), "crowded")
        if left.isEmpty():
            return
        rows = settle(rows.withColumn("cell", cell).join(F.broadcast(left) if small else left, "cell", "left_semi").drop("cell"), "open")
        low = high + 1


def _assigned(places: DataFrame, steps: list) -> DataFrame:
    """``places`` (settled) with the leaf of each row (LEAF), by the steps of their directory."""
    parts = [rows.withColumn("cell", cell).join(found, "cell").drop("cell") for rows, cell, found, _ in steps]
    return reduce(DataFrame.unionByName, parts) if parts else places.select("*", F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(c) for c in LEAF[1:]])


def _name() -> Column:
    return F.concat_ws("-", F.col("depth").cast("string"), F.col("prefix").cast("string"))


def _numbers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[field(c).alias(c) for c in dict.fromkeys((id_col, text_col))]).alias("doc"))
    return settle(_places(packed, id_col, text_col), "places")


def directory(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: shard, depth, prefix (its leading bits), shard_bytes, shard_docs."""
    leaves = [found.select(*LEAF).distinct() for _, _, found, _ in _grow(_numbers(docs, id_col, text_col), limit)]
    none = docs.sparkSession.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_docs long")
    return reduce(DataFrame.unionByName, leaves, none).select(_name().alias("shard"), *LEAF)


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (depth and prefix bits, as text), depth, shard_bytes, shard_docs."""
    places = _numbers(docs, id_col, text_col)
    placed = _assigned(places, list(_grow(places, limit)))
    return placed.select("doc_id", F.col("bytes").alias("n_bytes"), _name().alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their shard in a column ``shard`` (``shard_id`` where docs has one of that name).

    Each row is written once with its number and gets the shard of its own place, so rows of one id part where the limit asks for it. The directory is broadcast to the
    rows, which are not shuffled; one of more cells than SMALL is joined to the rows' numbers first."""
    taken = {c.lower() for c in docs.columns}
    name = "shard"
    while name in taken:
        name += "_id"
    packed = numbered(docs)
    places = settle(_places(packed, id_col, text_col), "places")
    steps = list(_grow(places, limit))
    if not all(small for *_, small in steps):
        placed = settle(_assigned(places, steps).select("row", _name().alias("shard")), "shards")
        discard(places)
        return packed.join(placed.hint("merge"), "row").select("doc.*", F.col("shard").alias(name))
    discard(places, *[rows for rows, *_ in steps if rows is not places])
    out = packed.withColumn("hash", _place(F.col("doc").getField(id_col), F.col("row")))
    shards = []
    for k, (_, cell, found, _) in enumerate(steps):  # a row has its cell in one step: cells of later steps lie in what earlier ones left open
        out = out.withColumn(f"cell{k}", cell).join(found.select(F.col("cell").alias(f"cell{k}"), _name().alias(f"shard{k}")), f"cell{k}", "left")
        shards.append(F.col(f"shard{k}"))
    return out.select("doc.*", (F.coalesce(*shards) if shards else F.lit("0-0")).alias(name))


def write(docs: DataFrame, path: str, limit: int = LIMIT, **options) -> None:
    """Write one folder per shard."""
    out = shard(docs, limit, **options)
    name = field(out.columns[-1])
    out.repartition(name).write.partitionBy(out.columns[-1]).parquet(path)
