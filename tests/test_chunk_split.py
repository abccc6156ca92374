"""The splitter against a naive one, over the texts of all documents of the smallest tables."""

import os
import re

import pyarrow.parquet as pq
import pytest

from marginalia.operators import chunking as C

PATH = "/root/testdata/sf0.001/documents.parquet"


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def naive(text, size, overlap, separators):
    """Strings cut before each separator, merged from the left while they fit, a merged piece begun with the last pieces of the one before that fit the overlap; a piece that is too large is cut by the next separator."""
    if tokens(text) <= size or not separators:
        return [text]
    mark, out, run = separators[0], [], []
    cuts = [m.start() for m in re.finditer(re.escape(mark), text) if m.start()] if mark else range(1, len(text))
    pieces = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]
    for piece in pieces:
        if run and tokens("".join(run)) + tokens(piece) > size:
            out.append("".join(run))
            while run and (tokens("".join(run)) > overlap or tokens("".join(run)) + tokens(piece) > size):
                run.pop(0)
        if tokens(piece) > size:
            out += naive(piece, size, overlap, separators[1:])
            run = []
        else:
            run.append(piece)
    if run:
        out.append("".join(run))
    return out


@pytest.mark.parametrize("size,overlap,separators", [(20, 0, ("\n",)), (60, 10, ("\n\n", "\n", " ")), (35, 8, ("\n", ". ", " ")), (12, 3, (" ",))])
def test_splitter_against_a_naive_one(size, overlap, separators):
    if not os.path.exists(PATH):
        pytest.skip("no tables here")
    texts = [t for t in pq.read_table(PATH, columns=["text"]).column(0).to_pylist() if t]
    n = 0
    for text in texts:
        text = text[:6000]  # the naive form is quadratic
        want = [c.strip() for c in naive(text, size, overlap, separators)]
        got = C.split(text, size, overlap, separators)
        assert got == [c for c in want if c], text[:80]
        assert all(tokens(c) <= size or not any(s in c for s in separators) for c in got)
        n += len(got) > 1
    assert n > 50
