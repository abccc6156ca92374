"""Adaptive context-mixing range coder for token ids.

A segment's ids are cut in blocks of equal length that are coded independently: each starts from the segment's vocabulary and fresh models, and
has its own code bytes and CRC-32. Up to ``LANES`` blocks advance together, one id a step, so that every operation is a numpy operation over blocks.

Three models predict an id, and their mixture is coded:

- order 2 and order 1 remember the id that last followed the two ids, or the one id, before, and how often in a row they were right. The two
  confidences together choose the mixture's weights, which adapt by how often each order was right with these confidences;
- order 0 has the rest of the weight: counts of 512 classes of ids, that adapt within the block. Nearly all ids that are frequent in the segment are a class of
  their own; rare ids share classes, and within one their shares are the segment's.

A block's counts begin at the segment's shares (``Vocabulary``, stored once a segment), so short blocks need not learn them again. The coder has
64-bit bounds, shifts out 32 bits at a time and carries into what it has written. All arithmetic is on whole numbers, so every machine decodes the same.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 2048
CLASSES, SHARED = 512, 64  # classes of order 0, and how many of them are shared by rare ids
_CONTEXT, _WEIGHT, _COUNT, _WITHIN = 8, 12, 18, 22  # bits: slots of a context table, mixture weights, class frequencies, frequencies within a class
_STEP, _PRIOR = 32, 16_000  # what an id adds to its class, and the sum of the counts that a block begins with
_COARSE, _PART = 16, 128  # classes to a place of the coarse table, lanes whose counts are summed at a time
_TURN, _LEAST, _MOST = 5, 64, 64_000  # pace and bounds of the mixture's weights, in 1/65536
_I, _U = ([np.array(k, kind) for k in range(33)] for kind in (np.int32, np.uint32))  # small numbers for steps: a Python number would be turned into such an array each time
_FULL, _LOW_HALF, _GAIN, _FLOOR = np.array(1 << _WEIGHT, np.int32), np.array(0xFFFF, np.uint32), np.array(_MOST - _LEAST, np.int32), np.array(_LEAST, np.int32)
_H = [np.array(x, np.uint32) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]  # factors of the contexts' hashes
_L, _TOP = np.uint64, np.array(1 << 32, np.uint64)
_BITS, _BEYOND = np.array(_WEIGHT + _COUNT, _L), np.array((1 << (_WEIGHT + _COUNT)) - 1, _L)


class Vocabulary:
    """The different ids of a segment by their frequency, with counts rounded to four bits."""

    HEAD = struct.Struct("<II")

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.lexsort((ids, -counts))
        self.ids, self.counts = ids[order].astype(np.uint32), counts[order].astype(np.int64)
        n = len(ids)
        own = n if n <= CLASSES else CLASSES - SHARED
        self.of_rank = np.arange(n)
        if n > own:
            upto = np.cumsum(self.counts[own:])
            self.of_rank[own:] = own + (upto - 1) * SHARED // upto[-1]
        self.first = np.searchsorted(self.of_rank, np.arange(CLASSES + 1))
        share = np.concatenate(([0], np.cumsum(self.counts)))
        mass = share[self.first[1:]] - share[self.first[:-1]]
        self.prior = (1 + mass * _PRIOR // max(1, share[-1])).astype(np.int64)
        # cumulative frequencies within each class, rising from class << _WITHIN on over all ranks
        size, total = np.diff(self.first)[self.of_rank], mass[self.of_rank]
        inner = share[:-1] - share[self.first[self.of_rank]]
        begin = np.arange(n) - self.first[self.of_rank]
        room = (1 << _WITHIN) - size
        self.cum = (self.of_rank << _WITHIN) + begin + (inner * room // np.maximum(total, 1))
        self.cum = np.append(self.cum, (self.of_rank[-1] + 1 if n else 0) << _WITHIN)
        after = np.append(self.cum[1:], self.cum[-1:])[:n]
        last = np.append(self.of_rank[1:] != self.of_rank[:-1], True)[:n]
        self.freq = np.where(last, (self.of_rank + 1) << _WITHIN, after) - self.cum[:-1]
        self.within, self.share = (self.cum[:-1] - (self.of_rank << _WITHIN)).astype(_L), self.freq.astype(_L)
        self.shared_from = own if n > own else CLASSES

    @classmethod
    def of(cls, ids: np.ndarray) -> Vocabulary:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        different = np.flatnonzero(counts)
        counts = counts[different]
        cut = np.maximum(np.frexp(counts)[1] - 4, 0)
        return cls(different, counts >> cut << cut)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        table = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 0, np.int32)
        table[self.ids] = np.arange(len(self.ids))
        return table[ids]

    def pack(self) -> bytes:
        order = np.argsort(self.ids)
        ids, counts = self.ids[order], self.counts[order]
        body = zlib.compress(np.diff(ids, prepend=np.uint32(0)).astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes() + counts.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes())
        return self.HEAD.pack(len(ids), len(body)) + body

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Vocabulary, int]:
        """The vocabulary, and how many bytes it has in ``data``."""
        n, size = cls.HEAD.unpack_from(data)
        end = cls.HEAD.size + size
        raw = np.frombuffer(zlib.decompress(data[cls.HEAD.size : end]), np.uint8).reshape(2, 4, n)
        gaps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
        return cls(np.cumsum(gaps, dtype=np.uint64).astype(np.uint32), counts.astype(np.int64)), end


class _Models:
    """Models of n blocks, side by side. Steps write in arrays made once, and operations do not mix types: at this size a new array or a cast costs more
    than the operation.

    What is right is told by masks, all bits or none: ``right[0]`` where order 2 is right, ``right[1]`` where order 1 is and order 2 is not, ``miss``
    where neither is."""

    def __init__(self, n: int, vocabulary: Vocabulary):
        self.n = n
        self.class_of = vocabulary.of_rank.astype(np.int32)
        self.row = n + 32  # of all tables: so that rows a power of two apart do not share their places in cache
        self.seen = np.zeros(2 * (self.row << _CONTEXT), np.int32)  # of order 2 and 1: an id's rank and, in three bits, how often in a row it was right
        start = np.array([1_500, 20_000, 30_000, 36_000, 42_000, 46_000, 50_000, 54_000])
        grid = np.arange(64)
        self.trust = np.repeat(start[grid >> 3] << 16 | start[grid & 7], self.row).astype(np.uint32)  # of order 2 in the upper half, of order 1 in the lower
        lanes = np.arange(n, dtype=np.int32)
        self.all_lanes, self.all_slots, self.counted = lanes, np.array([lanes, lanes + (self.row << _CONTEXT)]), 0
        self.counts = np.repeat(vocabulary.prior.astype(np.int32)[:, None], n, axis=1)  # by class and block, so that sums over classes are of whole rows
        table = np.zeros((CLASSES + 1, self.row), np.int32)
        table[-1] = 1 << _COUNT
        self.cum, self.table, self.coarse = table.reshape(-1), table[:, :n], np.zeros((CLASSES // _COARSE, n), np.int32)
        self.after, self.rows, self.stride = self.cum[self.row :], np.array(self.row, np.int32), np.array(_COARSE * self.row, np.int32)
        self.jumps = [(np.array(k * self.row, np.int32), self.cum[k * self.row :]) for k in (1 << x for x in reversed(range(_COARSE.bit_length() - 1)))]
        self.ranks = np.arange(1, CLASSES, dtype=np.int32)[:, None]
        self.before = [np.zeros(n, np.uint32)] * 2
        self._view(n)

    def _view(self, m: int) -> None:
        """Go on with the first m lanes."""
        self.m, self.before = m, [x[:m] for x in self.before]
        self.lane, self.slots = self.all_lanes[:m], np.ascontiguousarray(self.all_slots[:, :m])
        self.held, self.guess, self.times, self.p, self.right, self.pair = np.empty((6, 2, m), np.int32)
        self.w2, self.both, self.rest, self.miss, self.low, self.size, self.at, self.kind, self.a, self.b, self.c = np.empty((11, m), np.int32)
        self.hash, self.packed, self.index, self.context, self.wide = np.empty((2, m), np.uint32), np.empty(m, np.uint32), np.empty((2, m), np.int64), np.empty(m, np.int64), np.empty((2, m), _L)
        self.flag, self.reached = np.empty(m, bool), np.empty((len(self.coarse), m), bool)

    def begin(self, step: int, m: int, grid: np.ndarray) -> None:
        """``grid``: the ranks of all steps before this one."""
        if step % 256 == 0 or step in (32, 64, 128):  # frequencies stand still between these steps, so counts need not be kept at each
            done, sums = grid[self.counted : step], self.table[1:-1]
            for a in range(0, self.n, _PART) if step else ():
                lanes, counts = self.all_lanes[: min(_PART, self.n - a)], self.counts[:, a : a + _PART]
                kinds = self.class_of.take(done[:, a : a + _PART])
                kinds *= len(lanes)
                kinds += lanes
                counts += _STEP * np.bincount(kinds.reshape(-1), minlength=counts.size).reshape(counts.shape)
            np.copyto(sums[0], self.counts[0])
            for above, counts, row in zip(sums, self.counts[1:-1], sums[1:]):
                np.add(above, counts, row)
            scale = (((1 << _COUNT) - CLASSES << 24) // (sums[-1] + self.counts[-1].astype(np.int64))) / (1 << 24)
            for a in range(0, CLASSES - 1, _COARSE):
                part = sums[a : a + _COARSE]
                np.copyto(part, part * scale, casting="unsafe")  # whole numbers below 2**53, then a power of two: exact
                part += self.ranks[a : a + _COARSE]
            np.copyto(self.coarse, self.table[:-1:_COARSE])
            self.counted = step
        if m < self.m:
            self._view(m)

    def predict(self) -> None:
        """Guesses of order 2 and order 1, and the mixture's weights."""
        w2, both, a, (h2, h1) = self.w2, self.both, self.a, self.hash
        np.multiply(self.before[0], _H[0], h1)
        np.multiply(self.before[1], _H[1], h2)
        np.bitwise_xor(h2, h1, h2)
        np.multiply(h2, _H[2], h2)
        np.right_shift(self.hash, _U[32 - _CONTEXT], self.hash)
        np.multiply(self.hash.view(np.int32), self.rows, self.held)
        np.add(self.slots, self.held, self.held)
        np.copyto(self.index, self.held)
        self.seen.take(self.index, out=self.held, mode="clip")
        np.bitwise_and(self.held, _I[7], self.times)
        np.right_shift(self.held, _I[3], self.guess)
        np.left_shift(self.times[0], _I[3], a)
        np.bitwise_or(a, self.times[1], a)
        np.multiply(a, self.rows, a)
        np.add(self.lane, a, a)
        np.copyto(self.context, a)
        packed, (p2, p1) = self.trust.take(self.context, out=self.packed, mode="clip"), self.p
        np.right_shift(packed, _U[16], p2.view(np.uint32))
        np.bitwise_and(packed, _LOW_HALF, p1.view(np.uint32))
        np.right_shift(p2, _I[16 - _WEIGHT], w2)
        np.subtract(_FULL, w2, a)
        np.multiply(a, p1, a)
        np.right_shift(a, _I[16], a)
        np.add(a, w2, both)
        np.add(both, _I[1], both)
        np.subtract(_FULL, both, self.rest)

    def equal(self, rank: np.ndarray) -> np.ndarray:
        """Masks of the orders whose guess is this rank."""
        np.bitwise_xor(self.guess, rank, self.pair)
        np.subtract(self.pair, _I[1], self.pair)
        return np.right_shift(self.pair, _I[31], self.pair)

    def find(self, target: np.ndarray) -> np.ndarray:
        """Where in ``cum`` the part begins that holds the target, which is used up."""
        at, a, above = self.at, self.a, target
        np.less_equal(self.coarse[:, : self.m], target, self.reached)  # all places of a small table first
        np.copyto(at, np.add.reduce(self.reached.view(np.int8), axis=0, dtype=np.int8))
        np.subtract(at, _I[1], at)
        np.multiply(at, self.stride, at)
        np.add(at, self.lane, at)
        np.add(target, _I[1], above)
        for jump, beyond in self.jumps:
            beyond.take(at, out=a, mode="clip")
            np.subtract(a, above, a)
            np.right_shift(a, _I[31], a)
            np.bitwise_and(a, jump, a)
            np.add(at, a, at)
        return at

    def part(self, at: np.ndarray) -> None:
        """The frequencies below and of the class at a place of ``cum``."""
        self.cum.take(at, out=self.low, mode="clip")
        self.after.take(at, out=self.size, mode="clip")
        np.subtract(self.size, self.low, self.size)

    def learn(self, rank: np.ndarray, equal: np.ndarray) -> None:
        held, p, times, packed = self.held, self.p, self.times, self.packed
        np.bitwise_and(self.right, _GAIN, held)
        np.add(held, _FLOOR, held)
        np.subtract(held, p, held)
        np.right_shift(held, _I[_TURN], held)
        np.bitwise_and(held[1], np.invert(self.right[0], self.a), held[1])  # the trust in order 1 is for ids that order 2 has not guessed
        np.add(p, held, p)
        np.left_shift(p[0].view(np.uint32), _U[16], packed)
        np.bitwise_or(packed, p[1].view(np.uint32), packed)
        self.trust[self.context] = packed
        np.add(times, _I[1], times)
        np.minimum(times, _I[7], times)
        np.bitwise_and(times, equal, times)
        np.add(times, np.left_shift(rank, _I[3], self.a), times)
        self.seen[self.index] = times
        self.before = [rank.view(np.uint32), self.before[0]]

    def span(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the mixture's part, in 2**-(_WEIGHT + _COUNT)."""
        a, b, low, size, (right2, right1) = self.a, self.b, self.low, self.size, self.right
        np.bitwise_and(self.rest, self.miss, a)  # all parts are below 2**(_WEIGHT + _COUNT)
        np.multiply(low, a, low)
        np.multiply(size, a, size)
        np.bitwise_and(self.w2, right1, a)
        np.bitwise_or(a, np.bitwise_and(self.both, self.miss, b), a)
        np.add(low, np.left_shift(a, _I[_COUNT], a), low)
        np.subtract(self.both, self.w2, a)
        np.bitwise_and(a, right1, a)
        np.bitwise_or(a, np.bitwise_and(self.w2, right2, b), a)
        np.add(size, np.left_shift(a, _I[_COUNT], a), size)
        for wide, x in zip(self.wide, (low, size)):
            np.copyto(wide, x, casting="unsafe")
        return self.wide[0], self.wide[1]


class _Writer:
    """Lower bounds and ranges of the blocks' coders, and what they have written, in words of 32 bits."""

    def __init__(self, n: int, room: int):
        self.low, self.range = np.zeros(n, _L), np.full(n, (1 << 64) - 1, _L)
        self.out, self.room = np.zeros(n * room, np.uint32), room
        self.begins = np.arange(n) * room
        self.used = self.begins.copy()
        self.r, self.flag, self.carries = np.zeros(n, _L), np.zeros(n, bool), []

    def _carry(self, lanes: np.ndarray) -> None:
        self.carries.append(self.used[lanes] - 1)

    def _settle(self) -> None:
        """Add the carries to the words written."""
        at, self.carries = np.concatenate([np.zeros(0, np.int64), *self.carries]), []
        while len(at):
            at, times = np.unique(at, return_counts=True)
            words = self.out[at] + times.astype(np.uint32)
            self.out[at] = words
            at = at[words < times] - 1

    def _shift(self, lanes: np.ndarray) -> None:
        low, at = self.low[lanes], self.used[lanes]
        self.out[at] = low >> _L(32)
        self.used[lanes] = at + 1
        self.low[lanes] = low << _L(32)
        self.range[lanes] = self.range[lanes] << _L(32)

    def narrow(self, lanes: np.ndarray, cum: np.ndarray, freq: np.ndarray, bits: int) -> None:
        r = self.range[lanes] >> _L(bits)
        more = r * cum
        low = self.low[lanes] + more
        r *= freq
        self.low[lanes], self.range[lanes] = low, r
        over, short = np.flatnonzero(low < more), np.flatnonzero(r < _TOP)
        if len(over):
            self._carry(lanes[over])
        if len(short):
            self._shift(lanes[short])

    def narrow_all(self, cum: np.ndarray, freq: np.ndarray) -> None:
        """``narrow`` by the mixture of the first lanes, as many as ``cum`` has; ``cum`` is used up."""
        m = len(cum)
        r, low, span, flag = self.r[:m], self.low[:m], self.range[:m], self.flag[:m]
        np.right_shift(span, _BITS, r)
        np.multiply(cum, r, cum)
        np.add(low, cum, low)
        np.less(low, cum, flag)
        np.multiply(r, freq, span)
        over = np.flatnonzero(flag)
        if len(over):
            self._carry(over)
        short = np.flatnonzero(np.less(span, _TOP, flag))
        if len(short):
            self._shift(short)

    def make_room(self, most: int) -> None:
        used = self.used - self.begins
        if used.max() + most > self.room:
            self._settle()
            out = self.out.reshape(-1, self.room)
            self.out, self.room = np.concatenate((out, np.zeros_like(out)), axis=1).reshape(-1), 2 * self.room
            self.begins = np.arange(len(used)) * self.room
            self.used = self.begins + used

    def codes(self) -> list[bytes]:
        """The words written and as many bytes of a value within the last range as tell it from others."""
        whole = self.low + (self.range >> _L(1))
        over = np.flatnonzero(whole < self.low)
        if len(over):
            self._carry(over)
        self._settle()
        plain = self.out.astype(">u4")
        return [(plain[a:b].tobytes() + int(x).to_bytes(8, "big")[:5]).rstrip(b"\0") for a, b, x in zip(self.begins.tolist(), self.used.tolist(), whole.tolist())]


class _Reader:
    """The codes' distance from the lower bound, and the ranges."""

    def __init__(self, codes: list[bytes]):
        n, size = len(codes), [len(c) // 4 * 4 + 16 for c in codes]
        begins = np.concatenate(([0], np.cumsum(size)))[:-1] // 4
        self.data = np.frombuffer(b"".join(c.ljust(s, b"\0") for c, s in zip(codes, size)), ">u4").astype(_L)
        self.range = np.full(n, (1 << 64) - 1, _L)
        self.code = (self.data[begins] << _L(32)) | self.data[begins + 1]
        self.used = begins + 2
        self.r, self.found, self.flag, self.place = np.zeros(n, _L), np.zeros(n, _L), np.zeros(n, bool), np.zeros(n, np.int32)

    def target(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        r = self.range[lanes] >> _L(bits)
        return np.minimum(self.code[lanes] // r, _L((1 << bits) - 1)).view(np.int64)

    def _shift(self, lanes: np.ndarray) -> None:
        used = self.used[lanes]
        self.code[lanes] = (self.code[lanes] << _L(32)) | self.data.take(used, mode="clip")
        self.range[lanes] = self.range[lanes] << _L(32)
        self.used[lanes] = used + 1

    def narrow(self, lanes: np.ndarray, cum: np.ndarray, freq: np.ndarray, bits: int) -> None:
        r = self.range[lanes] >> _L(bits)
        self.code[lanes] -= r * cum
        r *= freq
        self.range[lanes] = r
        short = np.flatnonzero(r < _TOP)
        if len(short):
            self._shift(lanes[short])

    def target_all(self, m: int) -> np.ndarray:
        """``target`` in the mixture of the first m lanes."""
        found = self.found[:m]
        np.right_shift(self.range[:m], _BITS, self.r[:m])
        np.floor_divide(self.code[:m], self.r[:m], found)
        np.minimum(found, _BEYOND, found)
        np.copyto(self.place[:m], found, casting="unsafe")
        return self.place[:m]

    def narrow_all(self, cum: np.ndarray, freq: np.ndarray) -> None:
        """``narrow`` after ``target_all``; ``cum`` is used up."""
        m = len(cum)
        code, r, span = self.code[:m], self.r[:m], self.range[:m]
        np.multiply(cum, r, cum)
        np.subtract(code, cum, code)
        np.multiply(r, freq, span)
        short = np.flatnonzero(np.less(span, _TOP, self.flag[:m]))
        if len(short):
            self._shift(short)


def _sizes(n_ids: int, length: int) -> np.ndarray:
    sizes = np.full(-(-n_ids // length), length)
    if len(sizes):
        sizes[-1] = n_ids - length * (len(sizes) - 1)
    return sizes


def block_length(n_ids: int) -> int:
    """Of 256 to 2048 ids, so that few lanes stay empty."""
    rounds = -(-n_ids // (LANES * 2048))
    return int(max(256, -(-n_ids // (LANES * max(1, rounds)))))


def _turned(grid: np.ndarray) -> np.ndarray:
    """The transposed array, made in strips that stay in cache."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for a in range(0, len(grid), 32):
        out[:, a : a + 32] = grid[a : a + 32].T
    return out


def _encode(ranks: np.ndarray, length: int, sizes: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    n = len(sizes)
    grid = np.zeros(n * length, np.int32)
    grid[: len(ranks)] = ranks
    grid = _turned(grid.reshape(n, length))
    models, coder, shared = _Models(n, vocabulary), _Writer(n, length // 2 + 64), np.array(vocabulary.shared_from, np.int32)
    for step in range(length):
        m = n if step < sizes[-1] else n - 1
        if not m:
            break
        if step % 16 == 0:
            coder.make_room(64)
        rank = grid[step, :m]
        models.begin(step, m, grid)
        models.predict()
        kind, (right2, right1), miss, equal = models.kind, models.right, models.miss, models.equal(rank)
        models.class_of.take(rank, out=kind, mode="clip")
        np.copyto(right2, equal[0])
        np.bitwise_or(equal[0], equal[1], miss)
        np.bitwise_xor(miss, right2, right1)
        np.invert(miss, miss)
        np.multiply(kind, models.rows, models.at)
        models.part(np.add(models.at, models.lane, models.at))
        coder.narrow_all(*models.span())
        if vocabulary.shared_from < CLASSES:
            np.bitwise_and(kind, miss, models.a)
            rare = np.flatnonzero(np.greater_equal(models.a, shared, models.flag))
            if len(rare):
                own = rank[rare]
                coder.narrow(rare, vocabulary.within.take(own), vocabulary.share.take(own), _WITHIN)
        models.learn(rank, equal)
    return coder.codes()


def _decode(codes: list[bytes], length: int, sizes: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    n, last = len(sizes), len(vocabulary.ids) - 1
    first = np.minimum(vocabulary.first, last).astype(np.int32)
    grid = np.zeros((length, n), np.int32)
    models, coder, shared = _Models(n, vocabulary), _Reader(codes), np.array(vocabulary.shared_from, np.int32)
    for step in range(length):
        m = n if step < sizes[-1] else n - 1
        if not m:
            break
        models.begin(step, m, grid)
        models.predict()
        target, rank = coder.target_all(m), grid[step, :m]
        kind, (right2, right1), miss, a, b = models.kind, models.right, models.miss, models.a, models.b
        np.left_shift(models.w2, _I[_COUNT], a)
        np.subtract(target, a, right2)
        np.right_shift(right2, _I[31], right2)
        np.left_shift(models.both, _I[_COUNT], a)
        np.subtract(target, a, b)
        np.right_shift(b, _I[31], miss)
        np.bitwise_xor(miss, right2, right1)
        np.invert(miss, miss)
        np.bitwise_and(b, miss, b)
        np.floor_divide(b, models.rest, b)
        at = models.find(b)
        np.subtract(at, models.lane, kind)
        np.floor_divide(kind, models.rows, kind)
        first.take(kind, out=rank, mode="clip")
        np.bitwise_and(rank, miss, rank)
        for guess, right in zip(models.guess, models.right):
            np.bitwise_and(guess, right, a)
            np.bitwise_or(rank, a, rank)
        models.part(at)
        coder.narrow_all(*models.span())
        rare = np.flatnonzero(np.greater_equal(kind, shared, models.flag)) if vocabulary.shared_from < CLASSES else ()  # none where a guess is right: the target is then in the first class
        if len(rare):
            base = kind[rare].astype(np.int64) << _WITHIN
            own = vocabulary.cum.searchsorted(base + coder.target(rare, _WITHIN), "right") - 1
            own = np.minimum(own, last)
            coder.narrow(rare, vocabulary.within.take(own), vocabulary.share.take(own), _WITHIN)
            rank[rare] = own
        models.learn(rank, models.equal(rank))
    return _turned(grid).reshape(-1)


def encode(ids: np.ndarray, length: int, vocabulary: Vocabulary) -> tuple[list[bytes], list[int]]:
    """Code bytes and CRC-32 of each block."""
    sizes, ranks, plain, codes = _sizes(len(ids), length), vocabulary.ranks(ids), ids.astype("<u4"), []
    for a in range(0, len(sizes), LANES):
        codes += _encode(ranks[a * length : (a + LANES) * length], length, sizes[a : a + LANES], vocabulary)
    return codes, [zlib.crc32(plain[i * length : i * length + s].tobytes()) for i, s in enumerate(sizes.tolist())]


def decode(codes: list[bytes], checks: list[int], n_ids: int, length: int, vocabulary: Vocabulary) -> np.ndarray:
    """The ids of all blocks; ValueError if a block's checksum does not hold."""
    sizes, parts = _sizes(n_ids, length), []
    for a in range(0, len(sizes), LANES):
        parts.append(_decode(codes[a : a + LANES], length, sizes[a : a + LANES], vocabulary))
    ids = vocabulary.ids[np.concatenate(parts)[:n_ids]] if parts else np.zeros(0, np.uint32)
    plain = ids.astype("<u4")
    for i, (s, check) in enumerate(zip(sizes.tolist(), checks)):
        if zlib.crc32(plain[i * length : i * length + s].tobytes()) != check:
            raise ValueError(f"block {i} is damaged")
    return ids
