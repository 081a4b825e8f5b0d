"""Block files: blocks of rows in compressed sparse form, one zstd frame each, with a seek table.

A frame holds six numbers of four bytes (mark, version, first row, rows, columns, entries), the row
pointers padded to a full block, the columns (four bytes) and the values (two bytes each).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format.
MARK, VERSION = 0x5253435A, 2
SKIPPABLE, SEEK_MARK = 0x184D2A5E, 0x8F92EAB1
_SCHEMA = "start_row long, nrows_in_block int, ncols int, nnz long, indptr array<int>, indices array<int>, data array<int>"


#: Bytes that are fed to the decompressor at once where a file has no seek table.
PIECE = 1 << 16


def seek_table(f: BinaryIO) -> list[tuple[int, int]] | None:
    """(offset, packed bytes) of each frame from the table at the end of an open file; None if there is none."""
    end = f.seek(0, os.SEEK_END)
    if end < 17:
        return None
    f.seek(end - 9)
    n, flags, mark = struct.unpack("<IBI", f.read(9))
    width = 12 if flags & 0x80 else 8
    start = end - 9 - n * width - 8
    if mark != SEEK_MARK or start < 0:
        return None
    f.seek(start)
    body = f.read(8 + n * width)
    if struct.unpack_from("<I", body)[0] != SKIPPABLE:
        return None
    sizes = np.frombuffer(body, np.uint8, n * width, 8).reshape(n, width)[:, :4].copy().view("<u4")[:, 0].astype(np.int64)
    at = np.cumsum(sizes) - sizes
    return list(zip(at.tolist(), sizes.tolist())) if int(sizes.sum()) == start else None


def frames(f: BinaryIO) -> Iterator[bytes]:
    """Contents of the frames of an open file, one at a time, the seek table left out; each byte is read once."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    table = seek_table(f)
    if table is not None:
        for at, size in table:
            f.seek(at)
            yield unpack.decompressobj().decompress(f.read(size))
        return
    f.seek(0)
    rest = b""
    while True:
        rest = rest or f.read(PIECE)
        if not rest:
            return
        while len(rest) < 8 and (more := f.read(PIECE)):
            rest += more
        (mark,) = struct.unpack_from("<I", rest)
        if mark & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", rest, 4)
            skip = 8 + size - len(rest)
            rest = rest[8 + size :]
            if skip > 0:
                f.seek(skip, os.SEEK_CUR)
            continue
        d, out = unpack.decompressobj(), []
        while not d.eof:
            rest = rest or f.read(PIECE)
            if not rest:
                raise ValueError("a frame ends too early")
            out.append(d.decompress(rest))
            rest = d.unused_data if d.eof else b""
        yield b"".join(out)


def parse(frame: bytes) -> dict:
    """One block; ValueError if it is none."""
    mark, version, start, rows, ncols, nnz = struct.unpack_from("<6I", frame)
    if mark != MARK or version != VERSION:
        raise ValueError("not a block of this format")
    pointers = (len(frame) - 24 - 6 * nnz) // 4
    indptr = np.frombuffer(frame, "<u4", pointers, 24)
    indices = np.frombuffer(frame, "<u4", nnz, 24 + 4 * pointers)
    data = np.frombuffer(frame, "<u2", nnz, 24 + 4 * pointers + 4 * nnz)
    return {"start_row": start, "nrows_in_block": rows, "ncols": ncols, "nnz": nnz, "indptr": indptr[: rows + 1], "indices": indices, "data": data}


def write(path: str, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, ncols: int, block_rows: int = 16, first_row: int = 0) -> int:
    """Write the rows of one chunk; returns the number of blocks."""
    import zstandard

    packer, table, n = zstandard.ZstdCompressor(level=1), [], len(indptr) - 1
    with open(path, "wb") as f:
        for lo in range(0, n, block_rows):
            hi = min(lo + block_rows, n)
            ptr = np.asarray(indptr[lo : hi + 1], np.int64) - indptr[lo]
            padded = np.concatenate((ptr, np.full(block_rows - (hi - lo), ptr[-1]))).astype("<u4")
            a, b = int(indptr[lo]), int(indptr[hi])
            frame = struct.pack("<6I", MARK, VERSION, first_row + lo, hi - lo, ncols, b - a) + padded.tobytes() + np.asarray(indices[a:b]).astype("<u4").tobytes() + np.asarray(data[a:b]).astype("<u2").tobytes()
            packed = packer.compress(frame)
            table.append((len(packed), len(frame)))
            f.write(packed)
        body = b"".join(struct.pack("<2I", *t) for t in table) + struct.pack("<IBI", len(table), 0, SEEK_MARK)
        f.write(struct.pack("<2I", SKIPPABLE, len(body)) + body)
    return len(table)


def read_blocks(spark: SparkSession, paths: list[str], row_offsets: list[int] | None = None) -> DataFrame:
    """Blocks of the files, one task per file; first rows move by the offsets given."""
    offsets = row_offsets or [0] * len(paths)
    table = spark.createDataFrame(list(zip(paths, offsets)), "path string, offset long").repartitionByRange(max(1, len(paths)), "path")

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                with open(t["path"], "rb") as f:
                    for frame in frames(f):
                        b = parse(frame)
                        row = [b["start_row"] + t["offset"], b["nrows_in_block"], b["ncols"], b["nnz"], b["indptr"].tolist(), b["indices"].tolist(), b["data"].tolist()]
                        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])

    return table.mapInArrow(run, _SCHEMA)


def block_rows_of(frame: bytes) -> int:
    """Rows of a full block, from the padded pointers of any block of the file."""
    (nnz,) = struct.unpack_from("<I", frame, 20)
    return (len(frame) - 24 - 6 * nnz) // 4 - 1


def file_rows(path: str, rows: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, columns, values) of sorted rows of one file; rows that it does not hold are passed over.

    Only the blocks that hold a row asked for are read and unpacked, any number of rows at once.
    """
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    with open(path, "rb") as f:
        table = seek_table(f)
        if table is None:  # without the table every block has to be looked at
            blocks = {b["start_row"]: b for b in map(parse, frames(f))}
            for r in rows:
                b = next((b for s, b in blocks.items() if s <= r < s + b["nrows_in_block"]), None)
                if b:
                    i, j = b["indptr"][r - b["start_row"]], b["indptr"][r - b["start_row"] + 1]
                    yield r, b["indices"][i:j], b["data"][i:j]
            return
        if not table:
            return

        def block(k: int) -> bytes:
            f.seek(table[k][0])
            return unpack.decompressobj().decompress(f.read(table[k][1]))

        first = block(0)
        size, start = block_rows_of(first), parse(first)["start_row"]
        held, now = -1, None
        for r in rows:
            k = (r - start) // size
            if not 0 <= k < len(table):
                continue
            if k != held:
                held, now = k, parse(first if k == 0 else block(k))
            i = r - now["start_row"]
            if i < now["nrows_in_block"]:
                yield r, now["indices"][now["indptr"][i] : now["indptr"][i + 1]], now["data"][now["indptr"][i] : now["indptr"][i + 1]]


def read_rows(spark: SparkSession, paths: list[str], spans: list[tuple[int, int]]) -> DataFrame:
    """(row_id, cols, vals) of the rows in the runs (first, last) that the files hold, one task per file."""
    table = spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(max(1, len(paths)), "path")

    def run(batches):
        names, kinds = ["row_id", "cols", "vals"], [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[list] = [[], [], []]
                for r, col, val in file_rows(path, (r for lo, hi in spans for r in range(lo, hi + 1))):
                    for part, value in zip(rows, (r, col.astype(np.int32), val.astype(np.int32))):
                        part.append(value)
                    if len(rows[0]) == 4_096:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)
                        rows = [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)

    return table.mapInArrow(run, "row_id long, cols array<int>, vals array<int>")
