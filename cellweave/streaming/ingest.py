"""Block files and Parquet blocks that arrive over time.

A stream of written blocks is kept as a table of the latest writing of each block. The state is
bounded by the blocks, not by their contents: contents stay in the appended files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.blocks import read_blocks

SCHEMA = "chunk_num int, start_row long, nrows_in_block int, ncols int, nnz long, indptr array<int>, indices array<int>, data array<int>, written_at timestamp"


def block_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Blocks of a growing Parquet folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_blocks(stream: DataFrame, target: str, checkpoint: str):
    """Append the stream's blocks to a folder exactly once; ``entries(read_blocks(target))`` then has the current matrix."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_counts(stream: DataFrame, delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window, blocks, entries) of the blocks written in each window of time; later ones than ``delay`` are left out."""
    counted = stream.withColumn("n", F.coalesce(F.size("indices"), F.lit(0)))
    return counted.withWatermark("written_at", delay).groupBy(F.window("written_at", window)).agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("entries"))


def current_blocks(spark: SparkSession, target: str) -> DataFrame:
    """All blocks appended so far, with the identity of each stored row."""
    return read_blocks(spark, target)
