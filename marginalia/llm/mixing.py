"""Mixing sources to target weights.

Every document gets a hash-random key (the MD5 of seed and id). Within each source documents are sorted by key, in ranges of
the key that hold few rows each, so a source with a third of all rows is spread over as many tasks as it needs. Sums of token
counts by range give each range its offset, a window within the range gives each document its place, and the source is cut at
its exact budget. A budget above the source's size repeats whole epochs first.

Targets: sources in code-point order, null last, take the weights in turn. They share ``share`` of all sizes by weight; no
target exceeds ``epochs`` times its source, and the excess is shared again by weight among the others until none is above.

Cases: a null or empty text has size 0 and takes no words. Rows of one id, or of no id, are separate documents of equal key, in the order of a hash of their
texts; equal rows are alike, so reruns agree. A source of size 0 has target 0. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from marginalia.llm.util import discard, field, numbered, settle

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2.0
RANGE_ROWS = 20_000
WORDS = "[^\\x20\\x09-\\x0D]+"
_HEX = "0123456789abcdef"


def _sizes(rows: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``rows`` (row, doc) to row, doc_id, source, size and place: a row's key, then hashes of its text and of its number, in hexadecimal digits."""
    doc_id, text, source = (F.col("doc").getField(c) for c in (id_col, text_col, source_col))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    place = F.concat(key, *[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (F.xxhash64(text.cast("string")), F.xxhash64("row"))])
    size = F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return rows.select("row", doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), place.alias("place"), size.alias("size"))


def _place(sources: DataFrame) -> DataFrame:
    """The rank of each source by code point, null last: ranges of sources, their offsets, and a window within each range."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = settle(ranged, "sources")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(offsets, "part").select("source", "source_size", (F.col("before") + F.row_number().over(own) - 1).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target. Only two sums leave the executors in each round of sharing."""
    sources = _place(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_place = F.array(*[F.lit(float(w)) for w in weights])
    sources = settle(sources.withColumn("weight", F.get(by_place, F.pmod("place", F.lit(len(weights))).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(epochs))), "weights")
    level, total = None, None
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        total = (row["all"] or 0) * share if total is None else total
        now = (total - (row["used"] or 0.0)) / row["open"] if row["open"] else float("inf")
        if now == level or not row["open"]:
            level = now
            break
        level = now
    return sources.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most")).alias("target"))


def _ranges(sizes: DataFrame, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """``sizes`` with the range of each row, a beginning of its place, and the ranges' sums. Ranges hold about ``range_rows`` rows. Where one holds far more,
    as rows of one id have one key, its rows get longer beginnings: the whole key, then digits of the text's hash, then of the row number's hash."""
    digits = 0
    while 16**digits * range_rows < sizes.count() and digits < 8:
        digits += 1
    rows, more = sizes.withColumn("range", F.substring("place", 1, digits) if digits else F.lit("")), max(1, digits)
    for length in (32, 32 + more, 48, 48 + more, None):
        sums = settle(rows.groupBy("source", "range").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("n_rows")), "ranges")
        crowded = sums.where(F.col("n_rows") > 4 * range_rows).select(F.col("source").alias("c_source"), F.col("range").alias("c_range"))
        if length is None or crowded.isEmpty():
            break
        # at most one for each 4 * range_rows rows
        same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("range") == F.col("c_range"))
        rows = rows.join(F.broadcast(crowded), same, "left").withColumn("range", F.when(F.col("c_range").isNotNull(), F.substring("place", 1, length)).otherwise(F.col("range"))).drop("c_source", "c_range")
    return rows, sums


def _plan(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: float, range_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """The plan by row, and the settled tables that it is read from."""
    sizes = settle(sizes, "sizes")
    rows, sums = _ranges(sizes, range_rows)
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = W.partitionBy("source", "range").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))).select("row", "doc_id", "source", "size", (F.col("offset") + F.col("inner")).alias("before"))
    goals = targets(sizes, weights, share, epochs).select(F.col("source").alias("t_source"), "source_size", "target")
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("t_source")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("row", "doc_id", "size", "source_size", "target", (whole * F.col("size") + cut).cast("long").alias("taken"), "before", whole.alias("epochs"), rest.cast("long").alias("rest")), [sizes, sums]


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, before (words of the source that precede it), epochs, rest."""
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[field(c).alias(c) for c in dict.fromkeys((id_col, text_col, source_col))]).alias("doc"))
    return _plan(_sizes(packed, id_col, text_col, source_col, seed), weights, share, epochs, range_rows)[0].drop("row")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as its source's epochs say. A document that the budget cuts is whole
    in the mixture when at least half of it lies before the cut, so a source ends within half a document of its target. A
    document of no words stays once."""
    packed = numbered(docs)
    counts, held = _plan(_sizes(packed, id_col, text_col, source_col, seed), weights, share, epochs, range_rows)
    half = (F.col("rest") - F.col("before")) * 2 >= F.col("size")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + F.when(half & (F.col("rest") > F.col("before")), 1).otherwise(0)).cast("int")
    counts = settle(counts.select("row", copies.alias("copies")), "copies")
    discard(*held)
    joined = packed.join(counts.where("copies > 0").hint("merge"), "row")  # alike at every size
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")
