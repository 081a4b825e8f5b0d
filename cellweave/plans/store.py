"""The stored dataset: entries clustered by row and by column, row and column metadata, a description.

``x_rm`` is partitioned by ``row_chunk`` and sorted by row, ``x_cm`` by ``col_chunk`` and sorted by
column, so that a selection reads few directories and few row groups. ``_meta.json`` has the
shape, sizes and the names of the parts.
"""

from __future__ import annotations

import json
import os
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.config import settings
from cellweave.functions.scalars import chunk_of

META = "_meta.json"
VERSION = 1


def check_parameters(block_rows: int, max_rows: int, max_columns: int) -> None:
    """ValueError unless 1 <= block_rows <= 256 and 1 <= max_rows, max_columns <= 1,000,000."""
    if not 1 <= block_rows <= 256:
        raise ValueError(f"block_rows must be 1 to 256, not {block_rows}")
    for name, value in (("max_rows", max_rows), ("max_columns", max_columns)):
        if not 1 <= value <= 1_000_000:
            raise ValueError(f"{name} must be 1 to 1000000, not {value}")


def write_rows(x: DataFrame, path: str, size: int, together: bool = False) -> None:
    """Entries clustered by row: a chunk is bounded by its rows, so each goes to one task and file, unless the entries of chunks stand ``together`` already."""
    chunked = x.withColumn("row_chunk", chunk_of(F.col("row_id"), size))
    (chunked if together else chunked.repartition("row_chunk")).sortWithinPartitions("row_chunk", "row_id", "col_id").write.mode("overwrite").option("compression", "zstd").partitionBy("row_chunk").parquet(path)


def write_columns(x: DataFrame, path: str, size: int) -> None:
    """Entries clustered by column: ranges of (column, row), as one column may hold very many rows."""
    chunked = x.withColumn("col_chunk", chunk_of(F.col("col_id"), size))
    chunked.repartitionByRange("col_chunk", "col_id", "row_id").sortWithinPartitions("col_chunk", "col_id", "row_id").write.mode("overwrite").option("compression", "zstd").partitionBy("col_chunk").parquet(path)


def write_meta(path: str, meta: dict[str, Any]) -> None:
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, META), "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=1, sort_keys=True)


def read_meta(path: str) -> dict[str, Any]:
    with open(os.path.join(path, META), encoding="utf-8") as f:
        return json.load(f)


def write_store(
    path: str,
    x: DataFrame,
    obs: DataFrame,
    var: DataFrame,
    shape: tuple[int, int],
    block_rows: int | None = None,
    max_rows: int | None = None,
    max_columns: int | None = None,
    columns_too: bool = True,
    obs_name: str = "obs.parquet",
    extra: dict[str, Any] | None = None,
    together: bool = False,
) -> dict[str, Any]:
    """Write all parts; ``x`` has row_id, col_id, val as stored, the entries of each chunk of rows ``together`` in a task or anywhere. An empty matrix is fine."""
    block_rows = block_rows or settings.block_rows
    max_rows = max_rows or settings.max_rows_per_chunk
    max_columns = max_columns or settings.max_columns_per_chunk
    check_parameters(block_rows, max_rows, max_columns)
    for part in ("x_rm", "x_cm", obs_name, "var.parquet"):
        shutil.rmtree(os.path.join(path, part), ignore_errors=True)
    os.makedirs(path, exist_ok=True)
    spark = x.sparkSession
    x = x.select(F.col("row_id").cast("long").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), F.col("val").cast("int").alias("val"))
    write_rows(x, os.path.join(path, "x_rm"), max_rows, together)
    rows = spark.read.schema("row_id long, col_id int, val int, row_chunk int").parquet(os.path.join(path, "x_rm"))
    if columns_too:
        write_columns(rows.drop("row_chunk"), os.path.join(path, "x_cm"), max_columns)
    obs.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(path, obs_name))
    var.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(path, "var.parquet"))
    nnz = rows.count()
    meta = {
        "version": VERSION, "shape": list(shape), "nnz_total": nnz, "block_rows": block_rows, "max_rows_per_chunk": max_rows, "max_columns_per_chunk": max_columns,
        "num_chunks_rm": -(-shape[0] // max_rows), "num_chunks_cm": -(-shape[1] // max_columns) if columns_too else 0, "total_blocks_rm": shape[0] // max_rows * -(-max_rows // block_rows) + -(-(shape[0] % max_rows) // block_rows),
        "obs": obs_name, "var": "var.parquet", "columns_too": columns_too, **(extra or {}),
    }
    write_meta(path, meta)
    return meta


def read_part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Entries of ``x_rm`` or ``x_cm`` with their chunk column, by a fixed schema (no inference)."""
    chunk = "row_chunk" if name == "x_rm" else "col_chunk"
    return spark.read.schema(f"row_id long, col_id int, val int, {chunk} int").parquet(os.path.join(path, name))
