"""Comparison of two stores by digests of key ranges: rows are read, shuffled and compared only in ranges that differ.

Keys are dealt to ranges of their hash. Each side sends one row a range and task: how many rows, the exclusive or and the sum of a 64-bit digest of each row's key and fields. Equal stores are told by that alone;
else the rows of the ranges that differ meet in a full outer join. Two ranges with different rows look alike with a probability of about 2**-64 a range.

Cases: a null key is a key of its own. Nulls are told from empty values, and from each other's places. A key that stands several times on a side is compared as often as it stands. Empty stores differ in nothing.
Fields may be arrays and structs, not maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.sources.storage import discard, settle

RANGES = 4096


def row_digest(key: str, fields: list[str]) -> Column:
    """64 bits of a row's key and fields; arrays, maps and structs by their JSON text."""
    return F.xxhash64(F.to_json(F.struct(F.col(key).alias("k"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}))


def _dealt(rows: DataFrame, key: str, fields: list[str], ranges: int) -> DataFrame:
    return rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(ranges)).cast("int").alias("range"), F.col(key), *fields)


def range_digests(rows: DataFrame, key: str, fields: list[str], ranges: int = RANGES) -> DataFrame:
    """range, n, mixed, total: one row for each range that has rows."""
    digests = _dealt(rows, key, fields, ranges).select("range", row_digest(key, fields).alias("digest"))
    return digests.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("digest").alias("mixed"), F.sum(F.col("digest").cast("decimal(20,0)")).alias("total"))


def different_ranges(a: DataFrame, b: DataFrame) -> list[int]:
    """Ranges whose digests are not the same (at most the number of ranges)."""
    left, right = (x.select("range", F.struct("n", "mixed", "total").alias(name)) for x, name in ((a, "a"), (b, "b")))
    return [r["range"] for r in left.join(right, "range", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("range").orderBy("range").collect()]


def compare(stored: DataFrame, points: DataFrame, fields: list[str], key: str = "chunk_id", ranges: int = RANGES) -> tuple[DataFrame, dict]:
    """Rows that differ (key, difference: missing, extra, or the names of unequal fields), and how much was read for them: ranges, different, rows (of both sides in them) and all (rows)."""
    a, b = settle(range_digests(stored, key, fields, ranges), "digests"), settle(range_digests(points, key, fields, ranges), "digests")
    unequal = different_ranges(a, b)
    seen = a.select("range", "n").unionByName(b.select("range", "n")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("range").isin(unequal), F.col("n")).otherwise(0)).alias("rows")).first()
    discard(a, b)
    own = F.col("range").isin(unequal)
    left = _dealt(stored, key, fields, ranges).where(own).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("a"))
    right = _dealt(points, key, fields, ranges).where(own).groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("b"))
    both = left.join(right, left["key"].eqNullSafe(right["key"]), "full_outer").select(F.coalesce(left["key"], right["key"]).alias(key), "a", "b")
    named = [F.when(~F.transform("a", lambda x: x[f]).eqNullSafe(F.transform("b", lambda x: x[f])), F.lit(f)) for f in fields]
    difference = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise(F.array_join(F.array_compact(F.array(*named)), ","))
    rows = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, difference.alias("difference"))
    return rows, {"ranges": ranges, "different": len(unequal), "rows": seen["rows"] or 0, "all": seen["all"] or 0}
