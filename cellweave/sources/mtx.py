"""Matrix text files: header, Spark reader and writer."""

from __future__ import annotations

import os
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.scalars import parse_value
from cellweave.operators import matrix


def header(path: str) -> tuple[int, int, int]:
    """(rows, columns, entries) from the first line with three numbers that is no comment."""
    with open(path, encoding="utf-8") as f:
        first = f.readline()
        if not first.startswith("%%MatrixMarket"):
            raise ValueError(f"{path} is not a matrix file")
        for line in f:
            parts = line.split()
            if line.startswith("%") or len(parts) < 3:
                continue
            return int(parts[0]), int(parts[1]), int(parts[2])
    raise ValueError(f"{path} has no size line")


def _lines_before_entries(path: str) -> int:
    """Lines up to and with the size line."""
    with open(path, encoding="utf-8") as f:
        for k, line in enumerate(f):
            if k and not line.startswith("%") and len(line.split()) >= 3:
                return k + 1
    return 0


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, col_id, val) counted from 0, as they stand: repeated coordinates are kept.

    Entries outside the shape are left out, an entry without value counts 1, a value that is no
    finite number counts 0. The file is read in splits.
    """
    nrows, ncols, _ = header(path)
    skipped = _lines_before_entries(path)
    # the head of the file is in its first split: lines are numbered there, and elsewhere only kept
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    lines = lines.where(((F.col("block") > 0) | (F.col("at") >= skipped)) & ~F.col("value").startswith("%") & (F.trim("value") != ""))
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    entries = lines.select(part.alias("p"))
    entries = entries.select((F.get("p", F.lit(0)).try_cast("bigint") - 1).alias("row_id"), (F.get("p", F.lit(1)).try_cast("bigint") - 1).cast("int").alias("col_id"), parse_value(F.get("p", F.lit(2))).alias("val"))
    return entries.where(F.col("row_id").between(0, nrows - 1) & F.col("col_id").between(0, ncols - 1))


def write_mtx(x: DataFrame, folder: str, nrows: int, ncols: int, nnz: int) -> None:
    """Entries as text parts in a folder, counted from 1, with the size in ``_header.mtx``."""
    number = F.when(F.col("val") == F.floor("val"), F.col("val").cast("bigint").cast("string")).otherwise(F.col("val").cast("string"))
    x.select(F.concat_ws(" ", (F.col("row_id") + 1).cast("string"), (F.col("col_id") + 1).cast("string"), number).alias("value")).write.mode("overwrite").text(folder)
    with open(os.path.join(folder, "_header.mtx"), "w", encoding="utf-8") as f:
        f.write(f"%%MatrixMarket matrix coordinate real general\n{nrows} {ncols} {nnz}\n")


def write_rows(x: DataFrame, folder: str, start: int, end: int, ncols: int) -> dict[str, Any]:
    """Rows start .. end-1 as ``rows_<start>_<end>.mtx`` beside their ``_stats.txt``, each a file joined from parts.

    Row numbers in the file count from the chunk's first row. Returns the manifest's entry. The text
    is written by the tasks; only sizes come here.
    """
    name = f"rows_{start}_{end}"
    mine = x.where(F.col("row_id").between(start, end - 1)).select((F.col("row_id") - start).alias("row_id"), "col_id", "val")
    stats = matrix.row_stats(mine)
    nnz = stats.agg(F.coalesce(F.sum("nnz"), F.lit(0))).collect()[0][0]
    parts = os.path.join(folder, f"_{name}")
    write_mtx(mine, os.path.join(parts, "x"), end - start, ncols, nnz)
    join_parts(os.path.join(parts, "x"), os.path.join(folder, f"{name}.mtx"))
    every = x.sparkSession.range(end - start).withColumnRenamed("id", "row_id").join(stats, "row_id", "left").repartitionByRange("row_id").sortWithinPartitions("row_id")
    every.select(F.format_string("%d %.6f", F.coalesce("nnz", F.lit(0)), F.coalesce(F.col("total_counts").cast("double"), F.lit(0.0))).alias("value")).write.mode("overwrite").text(os.path.join(parts, "stats"))
    with open(os.path.join(parts, "stats", "_header.mtx"), "w", encoding="utf-8") as f:
        f.write("nnz total_counts\n")
    join_parts(os.path.join(parts, "stats"), os.path.join(folder, f"{name}_stats.txt"))
    shutil.rmtree(parts, ignore_errors=True)
    return {"mtx_file": f"{name}.mtx", "mtx_path": os.path.join(folder, f"{name}.mtx"), "row_start": start, "row_end": end, "n_rows": end - start, "row_stats_file": f"{name}_stats.txt"}


def write_column_counts(counts: DataFrame, path: str, ncols: int) -> None:
    """Entries of each column, one number per line; ``counts`` has col_id and nnz."""
    every = counts.sparkSession.range(ncols).select(F.col("id").cast("int").alias("col_id")).join(counts, "col_id", "left").orderBy("col_id")
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{r[0]}\n" for r in every.select(F.coalesce("nnz", F.lit(0))).toLocalIterator())


def join_parts(folder: str, target: str) -> None:
    """One file out of the parts, streamed."""
    with open(target, "wb") as out:
        for name in ["_header.mtx", *sorted(n for n in os.listdir(folder) if n.startswith("part-"))]:
            with open(os.path.join(folder, name), "rb") as f:
                while piece := f.read(1 << 20):
                    out.write(piece)
