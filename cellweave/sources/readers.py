"""Spark readers of source files: one task for each (file, range of rows)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from cellweave.sources.files import Source, open_source

#: Rows of a source that one task reads.
ROWS_PER_TASK = 131_072
#: Entries handed to Spark at once.
STEP = 4_096


def tasks(spark: SparkSession, sources: Sequence[Source], sizes: Sequence[int], rows: int = ROWS_PER_TASK) -> DataFrame:
    """(source_no, path, lo, hi), one partition each."""
    parts = [(s.number, s.path, lo, min(lo + rows, n)) for s, n in zip(sources, sizes) for lo in range(0, n, rows)]
    table = spark.createDataFrame(parts, "source_no int, path string, lo long, hi long")
    return table.repartitionByRange(max(1, len(parts)), "source_no", "lo")


def read_matrix(spark: SparkSession, sources: Sequence[Source], sizes: Sequence[int], rows: int = ROWS_PER_TASK) -> DataFrame:
    """(source_no, local_row, col_id, val) of all sources."""

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                source = open_source(t["path"])
                for lo in range(t["lo"], t["hi"], STEP):
                    row, col, val = source.read_x(lo, min(lo + STEP, t["hi"]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t["source_no"]), pa.int32()), pa.array(row, pa.int64()), pa.array(col, pa.int32()), pa.array(val, pa.float64())], ["source_no", "local_row", "col_id", "val"])

    return tasks(spark, sources, sizes, rows).mapInArrow(run, "source_no int, local_row long, col_id int, val double")


def read_obs(spark: SparkSession, sources: Sequence[Source], sizes: Sequence[int], columns: dict[str, pa.DataType], have: dict[int, list[str]], rows: int = ROWS_PER_TASK) -> DataFrame:
    """(source_no, local_row, columns…) of all sources in one plan, whatever their number.

    Columns that a source lacks are null; values are cast to the given types (to text where a
    source's type does not fit).
    """
    names = list(columns)

    def cast(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        if pa.types.is_string(kind):
            return pa.array([None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v) for v in values.tolist()], kind)
        return pa.array(values.tolist(), from_pandas=True).cast(kind)

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                source, own = open_source(t["path"]), set(have[t["source_no"]])
                for lo in range(t["lo"], t["hi"], 16 * STEP):
                    hi = min(lo + 16 * STEP, t["hi"])
                    got = source.read_obs(lo, hi, [n for n in names if n in own])
                    arrays = [cast(got[n], columns[n]) if n in got else pa.nulls(hi - lo, columns[n]) for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, t["source_no"]), pa.int32()), pa.array(np.arange(lo, hi), pa.int64()), *arrays], ["source_no", "local_row", *names])

    schema = "source_no int, local_row long" + "".join(f", `{n.replace('`', '``')}` {from_arrow_type(k).simpleString()}" for n, k in columns.items())
    return tasks(spark, sources, sizes, rows).mapInArrow(run, schema)


def read_genes(path: str) -> list[str]:
    """One name per line, trimmed, blank lines dropped; an empty list is a ValueError."""
    with open(path, encoding="utf-8") as f:
        genes = [line.strip() for line in f if line.strip()]
    if not genes:
        raise ValueError(f"{path} names no gene")
    return genes


def source_genes(spark: SparkSession, named: dict[int, list[str]]) -> DataFrame:
    """(source, gene, old_col) of the sources' columns."""
    rows = [(n, g, i) for n, genes in named.items() for i, g in enumerate(genes)]
    return spark.createDataFrame(rows, "source int, gene string, old_col int").select(F.col("source"), "gene", "old_col")
