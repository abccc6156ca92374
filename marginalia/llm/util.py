"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.sources.storage import discard, new_folder, settle, shared_folder  # noqa: F401


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null as empty; columns of other names cannot clash with what follows."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def field(name: str):
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def numbered(docs: DataFrame, name: str = "rows") -> DataFrame:
    """(row, doc): a number for each row, and its columns in a struct, where no name can clash. It is written once, so a number stays with its row."""
    return settle(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[field(c) for c in docs.columns]).alias("doc")), name)


def numbered_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text) of ``numbered`` rows."""
    return rows.select("row", F.col("doc").getField(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("doc").getField(text_col).cast("string"), F.lit("")).alias("text"))


def spread_join(rows: DataFrame, single: DataFrame, key: str, by: str, how: str = "inner", salts: int = 256) -> DataFrame:
    """``rows`` with the columns of ``single``, which has one row for each key, where a key may hold a third of all rows.

    The rows of a key are dealt to ``salts`` places by the column ``by``; ``single`` meets the places that a key has (at most ``salts`` rows for a
    key, combined in the tasks), and then each place its rows."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(17), by), F.lit(salts)).cast("int"))
    places = salted.select(key, "salt").distinct().join(single, key)
    return salted.join(places, [key, "salt"], how).drop("salt")


def crc32_mod(id_col: str, n: int):
    """The fold of a row: crc32 of its id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def hash_sample(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, by a hash of the key, in hash order.

    A threshold on the hash first leaves about 1.2 ``n`` rows of all tasks together, so what the tasks send for the ordered limit does not
    grow with their number."""
    total = df.count() if total is None else total
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(key)), 1)
    if total > n:
        df = df.where(place < F.lit(int(min(1.0, (1.2 * n + 100) / total) * (2**63 - 1))))
    return df.orderBy(place, key).limit(n)
