import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from marginalia.llm import range_coder as rc


def coded(ids, length):
    vocabulary = rc.Vocabulary.of(ids)
    packed = vocabulary.pack()
    again, size = rc.Vocabulary.unpack(packed + b"more")
    assert size == len(packed) and (again.ids == vocabulary.ids).all() and (again.cum == vocabulary.cum).all()
    return *rc.encode(ids, length, vocabulary), again


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=700), st.sampled_from([1, 7, 64, 300]))
def test_round_trip(ids, length):
    ids = np.array(ids, np.uint32)
    codes, checks, vocabulary = coded(ids, length)
    assert (rc.decode(codes, checks, len(ids), length, vocabulary) == ids).all()


def test_three_bytes_and_growth():
    ids = np.random.default_rng(0).integers(0, 1 << 24, 3000).astype(np.uint32)
    codes, checks, vocabulary = coded(ids, 256)
    assert (rc.decode(codes, checks, 3000, 256, vocabulary) == ids).all()


def test_more_blocks_than_lanes(monkeypatch):
    monkeypatch.setattr(rc, "LANES", 4)
    ids = np.random.default_rng(1).integers(0, 600, 5000).astype(np.uint32)
    codes, checks, vocabulary = coded(ids, 300)
    assert len(codes) == 17 and (rc.decode(codes, checks, 5000, 300, vocabulary) == ids).all()


def test_repetition_is_compressed_and_blocks_are_independent():
    ids = np.tile(np.array([5, 900, 31000], np.uint32), 1000)
    codes, checks, vocabulary = coded(ids, 1000)
    assert sum(map(len, codes)) < len(ids) * 2 / 4
    middle = rc.decode(codes[1:2], checks[1:2], 1000, 1000, vocabulary)
    assert (middle == ids[1000:2000]).all()


def test_every_order_helps():
    """An order-0 source of many ids costs little more than its entropy (guesses keep their share of order 0, so few ids would cost more); what follows from one id or two before is learned within a block."""
    rng = np.random.default_rng(2)

    def source(n):
        share = 1 / np.arange(1, n + 1)
        share /= share.sum()
        return rng.choice(n, 180_000, p=share), -(share * np.log2(share)).sum()

    def bits(ids):
        codes, _, vocabulary = coded(ids.astype(np.uint32), 2048)
        return 8 * (sum(map(len, codes)) + len(vocabulary.pack())) / len(ids)

    plain, least = source(2000)
    assert bits(plain) < 1.08 * least
    assert bits(plain) < 8 * len(zlib.compress(plain.astype("<u2").tobytes(), 9)) / len(plain)
    plain, _ = source(8)
    one, two = plain.copy(), plain.copy()
    one[1::2] = 8 + (5 * one[::2] + 3) % 8  # every second id follows from the one before
    two[1::3] += 8
    two[2::3] = 16 + (3 * two[::3] + two[1::3]) % 8  # every third from the two before
    for ids in (one, two):
        share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
        assert bits(ids) < -0.9 * (share * np.log2(share)).sum()


def test_checksum():
    ids = np.arange(500, dtype=np.uint32)
    codes, checks, vocabulary = coded(ids, 250)
    with pytest.raises(ValueError):
        rc.decode(codes, [checks[0], checks[1] ^ 1], 500, 250, vocabulary)
    with pytest.raises(ValueError):
        rc.decode([codes[0], codes[1][:4] + b"xyz" + codes[1][7:]], checks, 500, 250, vocabulary)


def test_counts_are_taken_at_refreshes_and_the_format_is_as_before():
    """The codes of the form that counted at each step; lanes of more than one part, a short last block."""
    ids = (np.arange(90_000, dtype=np.uint64) ** np.uint64(2) % np.uint64(7919) % np.uint64(1500)).astype(np.uint32)
    ids[::3] = 5
    codes, checks, vocabulary = coded(ids, 600)
    assert (len(codes), sum(map(len, codes)), zlib.crc32(b"".join(codes))) == (150, 96813, 3673745665)
    short, checks, vocabulary = coded(ids[:89_650], 600)
    assert (rc.decode(short, checks, 89_650, 600, vocabulary) == ids[:89_650]).all()
    assert not hasattr(rc._Models(4, vocabulary), "flat_counts")


def test_steps_make_no_new_arrays():
    ids = np.random.default_rng(3).integers(0, 900, 4096).astype(np.uint32)
    vocabulary = rc.Vocabulary.of(ids)
    models, grid = rc._Models(4, vocabulary), vocabulary.ranks(ids).reshape(-1, 4)
    held = []
    for step in range(40):
        models.begin(step, 4, grid)
        models.predict()
        models.learn(grid[step], models.equal(grid[step]))
        held.append((models.w2, models.both, models.rest, models.guess, models.times, models.cum))
    assert all(x is y for row in held for x, y in zip(row, held[0]))


def test_carries_are_added_afterwards():
    """Against whole numbers of any length; symbols at the top of the range, so that carries run through many words, and more words than there is room for."""
    rng, n = np.random.default_rng(4), 5
    coder, want = rc._Writer(n, 80), [[0, (1 << 64) - 1, 0] for _ in range(n)]
    for step in range(600):
        if step % 16 == 0:
            coder.make_room(64)
        freq = rng.integers(1, 1 << 20, n)
        cum = np.where(rng.random(n) < 0.9, (1 << 30) - freq, rng.integers(0, 1 << 29, n))
        for w, c, f in zip(want, cum.tolist(), freq.tolist()):
            r = w[1] >> 30
            w[0], w[1] = w[0] + r * c, r * f
            if w[1] < 1 << 32:
                w[:] = w[0] << 32, w[1] << 32, w[2] + 1
        coder.narrow_all(cum.astype(np.uint64), freq.astype(np.uint64))
    assert coder.room > 80
    assert coder.codes() == [((low + (r >> 1)) >> 24).to_bytes(4 * k + 5, "big").rstrip(b"\0") for low, r, k in want]
