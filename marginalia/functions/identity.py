"""Stable names of notes, chunks, points, collections and caches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
#: The URL namespace of RFC 4122
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_key(path: Column, content_hash: Column, version: Column, index: Column) -> Column:
    """SHA-256 over path, hash, version and chunk index, parted by NUL; null where one of them is blank."""
    parts = [path, content_hash, version, index.cast("string")]
    blank = F.lit(False)
    for p in parts:
        blank = blank | p.isNull() | (F.trim(p) == "")
    return F.when(~blank, F.sha2(F.concat_ws("\u0000", *parts), 256))


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def collection_name(*parts: Column) -> Column:
    """Cleaned parts joined by two underscores."""
    return F.concat_ws("__", *[F.lower(F.trim(F.regexp_replace(p, "[^a-zA-Z0-9_-]+", "-"), F.lit("-"))) for p in parts])


def cache_fingerprint(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def note_path(source: Column, name: Column) -> Column:
    return F.concat(source, F.lit("/"), name.cast("string"), F.lit(".md"))


def note_title(path: Column, chunk_id: Column | None = None) -> Column:
    """The file stem of a path; ``chunk-<id>`` where there is no path and an id is given."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return stem if chunk_id is None else F.coalesce(F.when(stem != "", stem), F.concat(F.lit("chunk-"), chunk_id.cast("string")))


def casefold(text: Column) -> Column:
    """A text without the case of any alphabet: upper case first, which writes out letters such as the German sharp s; both sigmas are one."""
    return F.lower(F.translate(F.upper(text), "Σ", "σ"))


def path_key(path: Column) -> Column:
    """The key under which links find a path: without ``.md``, in one case."""
    return casefold(F.regexp_replace(path, r"(?i)\.md$", ""))


def link_base(reference: Column) -> Column:
    """The target of a link without its anchor, a leading ``./`` and a trailing ``.md``."""
    cut = F.trim(F.split(reference, "[#^]", 2)[0])
    return F.regexp_replace(F.regexp_replace(cut, r"^\./", ""), r"\.md$", "")


def retrieval_key(point: Column, chunk_id: Column, version: Column) -> Column:
    return F.coalesce(point, F.concat_ws(":", chunk_id.cast("string"), version))


def metric_name(name: Column, k: Column | None = None) -> Column:
    """A metric's name of safe characters, with ``_at_k`` where k is given."""
    clean = F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_")
    return clean if k is None else F.concat(clean, F.lit("_at_"), k.cast("string"))
