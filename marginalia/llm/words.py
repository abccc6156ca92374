"""Words and shingles of many texts at once, as numpy arrays over an Arrow buffer.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, with A-Z lower-cased. It is known by a
64-bit hash of two polynomials in its bytes, got from prefix sums, so that no Python code runs per word: one modulo 2**64, and, since that is the same for
some long words of two letters whatever its base, one modulo the prime 2**31 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 16  # bytes hashed at a time, so that temporary arrays stay in cache
_BASE = 0x9E3779B97F4A7C15
_PRIME = np.uint64((1 << 31) - 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_STEP = np.uint64(0xD6E8FEB86659FD93)

_code = np.arange(256)
_digit = (_code >= 48) & (_code <= 57)
_upper = (_code >= 65) & (_code <= 90)
_lower = (_code >= 97) & (_code <= 122)
IS_WORD = _digit | _upper | _lower | (_code >= 128)
LETTER = _upper | _lower
LOWER = np.where(_upper, _code + 32, _code).astype(np.uint8)
NOT_BLANK = ~((_code == 32) | ((_code >= 9) & (_code <= 13)))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, int(_PRIME))) % _PRIME
        have += more
    return out


def _tables(n: int) -> tuple[np.ndarray, ...]:
    """Powers of both bases and of their inverses."""
    prime = int(_PRIME)
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n), _prime_powers(_BASE % prime, n), _prime_powers(pow(_BASE, -1, prime), n)


class _Tables:
    held = ()

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, ...]:
        if n > _SEGMENT:
            return _tables(n)
        cls.held = cls.held or _tables(_SEGMENT)
        return cls.held


def text_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column in runs of rows of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    n, at = len(column), column.offset
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield first, end, buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def look(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """``table.take(buf)`` of a table of 256 bytes, read-only."""
    return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype)


def _edges(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of ``inside``; a text that begins at one of ``edges`` begins a new run."""
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)


def spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words end to end, the words' lengths, and per text the index of its first word (and the end).

    Words are cut between a byte of ``left`` and one of ``right``."""
    if not len(buf):
        return buf, np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edges = offs[offs < len(buf)]
    if left is None:
        inside = look(is_word, buf)
    else:  # all three tables in one
        kinds = look((is_word | left * 2 | right * 4).astype(np.uint8), buf)
        inside = (kinds & 1).view(bool)
        edges = np.concatenate((edges, np.flatnonzero(((kinds[:-1] >> 1) & (kinds[1:] >> 2) & 1).view(bool)) + 1))
    start, last = _edges(inside, edges)
    return np.frombuffer(buf.tobytes().translate(None, np.flatnonzero(~is_word).astype(np.uint8).tobytes()), np.uint8), last - start + 1, np.searchsorted(start, offs).astype(np.int64)


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD, fold: np.ndarray | None = LOWER, heads: tuple[int, ...] = ()):
    """Hashes of all words, their first bytes and end bytes, and per text the index of its first word (and the end).

    ``heads``: lengths in bytes; the hashes of the words' beginnings of these lengths follow, 0 where a word is not longer.
    """
    hashes, begins, stops, a, n = [], [], [], 0, len(buf)
    tops: list[list[np.ndarray]] = [[] for _ in heads]
    while a < n:
        b = min(a + _SEGMENT, n)
        while b < n:  # cut between words: after a separator, or between two texts
            run = np.flatnonzero(~is_word[buf[a:b]])
            cut = a + int(run[-1]) + 1 if len(run) else a
            edge = int(offs[np.searchsorted(offs, b, "right") - 1])
            if max(cut, edge) > a:
                b = max(cut, edge)
                break
            b = min(b + _SEGMENT, n)
        seg = buf[a:b]
        power, inverse, prime_power, prime_inverse = _Tables.upto(len(seg))
        inside = is_word[seg]
        s, e = _edges(inside, offs[np.searchsorted(offs, a, "left") : np.searchsorted(offs, b, "left")] - a)
        value = (seg if fold is None else fold[seg]).astype(np.uint64)
        value += np.uint64(1)
        second = value * prime_power[: len(seg)]
        if len(seg) > 1 << 23:  # sums of smaller runs stay below 2**64
            second %= _PRIME
        np.cumsum(second, out=second)
        value *= power[: len(seg)]
        np.cumsum(value, out=value)
        h, base = value[e], np.where(s > 0, value[s - 1], np.uint64(0))
        h -= base
        h *= inverse[s]
        second = (second[e] - np.where(s > 0, second[s - 1], np.uint64(0))) % _PRIME * prime_inverse[s] % _PRIME
        hashes.append(mix(mix(h) + second * _STEP))
        for top, m in zip(tops, heads):
            head = (value[np.minimum(s + (m - 1), len(seg) - 1)] - base) * inverse[s]
            top.append(np.where(e - s >= m, mix(head + np.uint64(m)), np.uint64(0)))
        begins.append(s + a)
        stops.append(e + (a + 1))
        a = b
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offs), np.int64), *(np.zeros(0, np.uint64) for _ in heads)
    start = np.concatenate(begins)
    return np.concatenate(hashes), start, np.concatenate(stops), np.searchsorted(start, offs).astype(np.int64), *(np.concatenate(t) for t in tops)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (the last n-1 places hold no meaning)."""
    out = np.zeros(len(hashes), np.uint64)
    for j in range(n):
        out *= _STEP
        if j:
            out[:-j] += hashes[j:]
        else:
            out += hashes
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5):
    """Shingle hashes, the word each begins at, and per text the index of its first shingle (and the end).

    A text of one to n-1 words has one shingle, of all its words; an empty text has none.
    """
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    s, keep = chain(hashes, n), np.ones(len(hashes), bool)
    for j in range(1, n):
        at = first[1:] - j
        keep[at[at >= 0]] = False
    size = np.diff(first)
    for k in range(1, n):
        at = first[:-1][size == k]
        if len(at):
            short = np.full(len(at), k, np.uint64)
            for j in range(k):
                short = mix(short * _STEP + hashes[at + j])
            s[at], keep[at] = short, True
    count = np.concatenate(([0], np.cumsum(keep)))
    where = np.flatnonzero(keep)
    return s[where], where, count[first]


def text_key(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words, equal for equal sequences (signed, for Spark's long)."""
    n = np.diff(first)
    if not len(hashes):
        return np.zeros((2, len(n)), np.int64)
    place = (np.arange(len(hashes)) - np.repeat(first[:-1], n)).astype(np.uint64)
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place * np.uint64(2) + np.uint64(salt))))))
        out.append(mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64))
    return np.array(out)
