"""Dense row numbers over many sources, without ordering everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut


def source_offsets(counts: DataFrame, source: str = "source_no", rows: str = "n_rows") -> DataFrame:
    """(source_no, n_rows, row_offset): rows before each source, from one row per source."""
    before = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(source, rows, F.coalesce(F.sum(rows).over(before), F.lit(0)).cast("long").alias("row_offset"))


def global_rows(x: DataFrame, offsets: DataFrame, local: str = "local_row", source: str = "source_no", name: str = "row_id") -> DataFrame:
    """Adds ``row_offset + local_row``; the offsets have one row per source and are joined by it."""
    return x.join(offsets.select(source, "row_offset"), source).withColumn(name, (F.col("row_offset") + F.col(local)).cast("long")).drop("row_offset")


def dense_rank(df: DataFrame, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Position 0, 1, … of each row in a total order of ``order``, over any number of rows.

    Rows are range-partitioned by the order, counted per partition, and numbered within it; only
    the counts (one per partition) pass through one task. The ranges come from a sample, so the
    numbered rows are kept in the shared folder: counts and rows must see the same ranges, also
    when an executor is lost. Equal rows share a partition and take any of their places.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    numbered = cut(ranged.withColumn("_at", F.row_number().over(own) - 1))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n_rows"))
    offsets = source_offsets(counts, "_part")
    return numbered.join(F.broadcast(offsets.select("_part", "row_offset")), "_part").withColumn(name, (F.col("row_offset") + F.col("_at")).cast("long")).drop("_part", "_at", "row_offset")
