"""Aligning the columns of sources to one ordered list of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import join_checked


def gene_list(spark: SparkSession, genes: list[str]) -> DataFrame:
    """(gene, new_col): trimmed, blanks dropped; of a name that stands twice the last place counts."""
    clean = [g.strip() for g in genes if g and g.strip()]
    if not clean:
        raise ValueError("the gene list is empty")
    return spark.createDataFrame(list({g: i for i, g in enumerate(clean)}.items()), "gene string, new_col int")


def gene_map(source_genes: DataFrame, target: DataFrame) -> DataFrame:
    """(source, old_col, new_col) from source genes (source, gene, old_col) and the list (gene, new_col).

    A gene that a source names twice stands for its last column there; genes not in the list are dropped.
    """
    last = source_genes.where("gene is not null").groupBy("source", "gene").agg(F.max("old_col").alias("old_col"))
    return join_checked(last, target.select("gene", "new_col"), "gene").select("source", "old_col", "new_col")


def remap(x: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entries (source, …, col_id, val) with the columns of the target list; unmapped ones are dropped."""
    keys = mapping.select("source", F.col("old_col").alias("col_id"), "new_col")
    return join_checked(x, keys, ["source", "col_id"]).withColumn("col_id", F.col("new_col")).drop("new_col")


def with_empty_columns(stats: DataFrame, target: DataFrame) -> DataFrame:
    """(gene, index, nnz) of every gene of the list, 0 where no source has it."""
    return target.join(stats.withColumnRenamed("col_id", "new_col"), "new_col", "left").select("gene", F.col("new_col").cast("long").alias("index"), F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def overlap(source_genes: DataFrame) -> DataFrame:
    """(source, n_genes, seen_before, in_all): genes of each source, how many an earlier source had, and how many all have."""
    distinct = source_genes.where("gene is not null").select("source", "gene").distinct()
    first = distinct.groupBy("gene").agg(F.min("source").alias("first"), F.count(F.lit(1)).alias("k"))
    sources = distinct.select("source").distinct().agg(F.count(F.lit(1)).alias("n_sources"))
    both = distinct.join(first, "gene").join(F.broadcast(sources), F.lit(True))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_genes"), F.count_if(F.col("first") < F.col("source")).alias("seen_before"), F.count_if(F.col("k") == F.col("n_sources")).alias("in_all"))
