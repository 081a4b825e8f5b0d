"""Row blocks in compressed sparse row form: one row per written block, arrays inside.

``latest_blocks`` resolves blocks written more than once; ``decode`` turns an Arrow batch
of blocks into flat entry arrays; ``sum_cells`` adds up repeated coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import small_rows

COLUMNS = ("start_row", "nrows_in_block", "ncols", "indptr", "indices", "data")
#: Blocks handled together in Python; bounds the memory of a worker.
SLICE = 256
#: Most rewritten blocks whose winners are broadcast; beyond, a shuffled join picks them.
MOST_REWRITTEN = 100_000


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a Parquet folder with the identity of each stored row (``_file``, ``_at``)."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def latest_blocks(df: DataFrame, most: int = MOST_REWRITTEN) -> DataFrame:
    """One block per ``start_row``: the latest ``written_at`` (null counts as oldest).

    Of equal times, which are equal in content, exactly one is kept. Blocks without
    ``start_row`` have no address and are left out. The choice is made on narrow columns
    with map-side aggregation, so a block written very often costs no large task; arrays
    are not shuffled while the rewritten blocks are few.
    """
    df = df.where(F.col("start_row").isNotNull())
    if "_file" not in df.columns or "_at" not in df.columns:
        # no row identity: take whole rows through the aggregate
        whole = F.struct(*[F.col(c) for c in COLUMNS])
        best = df.groupBy("start_row").agg(F.max_by(whole, F.coalesce(F.unix_micros("written_at"), F.lit(-(2**62)))).alias("b"))
        return best.select("b.*")
    top = F.max(F.struct("written_at", "_file", "_at"))
    again = df.groupBy("start_row").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).where("n > 1")
    again = again.select("start_row", F.col("top._file").alias("w_file"), F.col("top._at").alias("w_at"))
    rows = small_rows(again, most)
    if rows is not None:
        again = F.broadcast(df.sparkSession.createDataFrame(rows, again.schema))
    kept = df.join(again, "start_row", "left").where(F.col("w_at").isNull() | ((F.col("w_at") == F.col("_at")) & (F.col("w_file") == F.col("_file"))))
    return kept.select(*COLUMNS)


def _flat(column: pa.Array, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null lists are empty, null elements are ``missing``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null([])
    values = column.flatten()
    if values.null_count:
        values = values.fill_null(missing)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def decode(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, row of each entry, column of each entry, value of each entry) of a batch of blocks.

    ``cells`` are the row indexes of all cells, those without entries included. Entries with
    a column outside 0 .. ncols-1 are not entries; header ``nnz`` is not consulted.
    """
    ptr, ptr_at = _flat(batch.column(batch.schema.get_field_index("indptr")), 0)
    idx, idx_at = _flat(batch.column(batch.schema.get_field_index("indices")), -1)
    val, val_at = _flat(batch.column(batch.schema.get_field_index("data")), 0)
    get = lambda name, missing: batch.column(batch.schema.get_field_index(name)).fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)
    start, nrows, ncols = get("start_row", 0), get("nrows_in_block", -1), get("ncols", 2**31 - 1)
    have = np.maximum(np.diff(ptr_at) - 1, 0)
    nrows = np.where(nrows < 0, have, nrows)
    used = np.minimum(nrows, have)
    block = np.repeat(np.arange(len(start)), nrows)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(nrows) - nrows, nrows)
    cells = start[block] + inside
    keep = inside < used[block]
    b, i = block[keep], inside[keep]
    at = ptr_at[b] + i
    room = np.minimum(np.diff(idx_at), np.diff(val_at))[b]
    low = np.clip(ptr[at].astype(np.int64), 0, room) if len(at) else np.zeros(0, np.int64)
    high = np.clip(ptr[at + 1].astype(np.int64), low, room) if len(at) else low
    count = high - low
    total = int(count.sum())
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    where = np.repeat(idx_at[b] + low, count) + step
    col = idx[where].astype(np.int64)
    data = val[np.repeat(val_at[b] + low, count) + step].astype(np.int64)
    row = np.repeat(start[b] + i, count)
    good = (col >= 0) & (col < np.repeat(ncols[b], count))
    if not good.all():
        row, col, data = row[good], col[good], data[good]
    return cells, row, col, data


def sum_cells(row: np.ndarray, col: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries ordered by (row, column) with repeated coordinates added up."""
    if not len(row):
        return row, col, data
    base = row.min()
    width = int(col.max()) + 1
    key = (row - base) * width + col
    order = np.argsort(key, kind="stable")
    key, data = key[order], data[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[first]
    return key // width + base, key % width, np.add.reduceat(data, first)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def entries(blocks: DataFrame, most: int = MOST_REWRITTEN, chunk: int = 0) -> DataFrame:
    """The matrix as coordinates (``row_id``, ``col_id``, ``val``), repeated coordinates summed.

    With ``chunk``, blocks that begin in the same so many rows are brought into one task before they are taken
    apart, as they are smaller than their entries.
    """

    def run(batches):
        for batch in slices(batches):
            _, row, col, data = decode(batch)
            row, col, data = sum_cells(row, col, data)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(col, pa.int32()), pa.array(data, pa.int64())], ["row_id", "col_id", "val"])

    latest = latest_blocks(blocks, most)
    if chunk:
        latest = latest.repartition(F.floor(F.col("start_row") / chunk))
    return latest.mapInArrow(run, "row_id long, col_id int, val long")


def row_counts(blocks: DataFrame, most: int = MOST_REWRITTEN) -> DataFrame:
    """``matrix.row_stats`` of the entries, counted while blocks are taken apart."""

    def run(batches):
        for batch in slices(batches):
            row, _, data = sum_cells(*decode(batch)[1:])
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            total = np.add.reduceat(data, first) if len(row) else data
            yield pa.RecordBatch.from_arrays([pa.array(row[first], pa.int64()), pa.array(np.diff(np.append(first, len(row))), pa.int64()), pa.array(total, pa.int64())], ["row_id", "nnz", "total"])

    parts = latest_blocks(blocks, most).mapInArrow(run, "row_id long, nnz long, total long")
    return parts.groupBy("row_id").agg(F.sum("nnz").alias("nnz"), F.sum("total").cast("float").alias("total_counts"))


def col_counts(blocks: DataFrame, most: int = MOST_REWRITTEN) -> DataFrame:
    """``matrix.col_stats`` of the entries, counted while blocks are taken apart."""

    def run(batches):
        for batch in slices(batches):
            col, n = np.unique(sum_cells(*decode(batch)[1:])[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array(n, pa.int64())], ["col_id", "nnz"])

    return latest_blocks(blocks, most).mapInArrow(run, "col_id int, nnz long").groupBy("col_id").agg(F.sum("nnz").alias("nnz"))
