"""Small tables for tests."""

import datetime as dt

import numpy as np

BLOCK_SCHEMA = "chunk_num int, start_row long, nrows_in_block int, ncols int, nnz long, indptr array<int>, indices array<int>, data array<int>, written_at timestamp"
T0 = dt.datetime(2020, 1, 1)


def block(start, cells, ncols=100, at=0, nnz=None):
    """A block from a list of cells, each a list of (column, value)."""
    indptr = np.concatenate(([0], np.cumsum([len(c) for c in cells]))).tolist()
    flat = [e for c in cells for e in c]
    return (0, start, len(cells), ncols, nnz, [int(i) for i in indptr], [int(c) for c, _ in flat], [int(v) for _, v in flat], T0 + dt.timedelta(seconds=at))


def blocks_of(cells, size=4, **kw):
    return [block(i, cells[i : i + size], **kw) for i in range(0, len(cells), size)]


def dense(cells, ncols):
    x = np.zeros((len(cells), ncols))
    for i, c in enumerate(cells):
        for col, v in c:
            if 0 <= col < ncols:
                x[i, col] += v
    return x
