"""Queries of the training-data operators, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import clusters, frequency, mixing, percentiles, pii, tokenizer, topn
from cellweave.operators.blocks import read_blocks


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return read_blocks(spark, f"{d}/blockcsr.parquet")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found_clusters(_blocks(spark, d))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe_clusters(_blocks(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.gene_frequencies(_blocks(spark, d), _table(spark, d, "var_genes")).select("gene", "entries", "cells", "all_cells", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.gene_frequencies(_blocks(spark, d), _table(spark, d, "var_genes")).where("mark != ''").select("gene", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents, parted at blanks."""
    words = _table(spark, d, "documents").select(F.filter(F.split("text", " "), lambda w: w != "").alias("words"))
    return frequency.term_frequencies(words, "words")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_genes(_blocks(spark, d), 3).select("row_index", "rank_no", "gene_index")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.far_outside(_table(spark, d, "obs"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.file_percentiles(_table(spark, d, "obs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    sized = tokenizer.token_counts(_table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.short_sources(sized, _table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = tokenizer.token_counts(_table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mix(sized, _table(spark, d, "mix_targets")).select("doc_id", "source", "n_tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = tokenizer.token_counts(_table(spark, d, "documents"), ["doc_id", "source"])
    return mixing.mix_shares(sized, _table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(_table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p3_found, p3_counts, p3_terms, p4_found, p5_found, p5_percentiles, p7_ids, p8_found, p8_mix, p8_shares, p9_found, p9_redacted)}
