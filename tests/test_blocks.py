from pyspark.sql.functions import spark_partition_id

from cellweave.operators import matrix
from cellweave.operators.blocks import col_counts, entries, read_blocks, row_counts
from tests.fixtures import BLOCK_SCHEMA, block


def rows(df):
    return sorted((r.row_id, r.col_id, r.val) for r in df.collect())


def test_latest_writing_counts_and_repeats_add_up(spark, tmp_path):
    data = [
        block(0, [[(1, 5)], [(2, 1)]], at=0),
        block(0, [[(1, 7), (1, 2)], []], at=5, nnz=99),
        block(2, [[(150, 3), (-1, 4), (99, 1)]], at=1),
        block(2, [[(150, 3), (-1, 4), (99, 1)]], at=1),
    ]
    df = spark.createDataFrame(data, BLOCK_SCHEMA)
    expected = [(0, 1, 9), (2, 99, 1)]
    assert rows(entries(df)) == expected
    path = str(tmp_path / "b.parquet")
    df.repartition(3).write.parquet(path)
    assert rows(entries(read_blocks(spark, path))) == expected
    assert rows(entries(read_blocks(spark, path), most=0)) == expected  # beyond the bound of the broadcast


def test_nulls_and_empty(spark):
    data = [(0, 0, None, None, None, [0, 2], [3, None], [1, 2], None), (0, 5, 2, 10, 0, None, None, None, None), (0, None, 1, 10, 0, [0, 1], [1], [1], None)]
    df = spark.createDataFrame(data, BLOCK_SCHEMA)
    assert rows(entries(df)) == [(0, 3, 1)]
    assert rows(entries(df.limit(0))) == []


def test_rows_of_data_shorter_than_indices_and_extra_columns(spark):
    df = spark.createDataFrame([(0, 0, 1, 10, 3, [0, 3], [1, 2, 3], [7, 8], None)], BLOCK_SCHEMA).selectExpr("*", "1 as row_id", "2 as val")
    assert rows(entries(df)) == [(0, 1, 7), (0, 2, 8)]


def test_counts_are_those_of_the_entries_and_chunks_stay_together(spark):
    data = [block(i, [[(1, 5), (1, 2), (k, 0)] if k % 3 else [] for k in range(i, i + 2)]) for i in range(0, 40, 2)] + [block(4, [[(2, 1)], [(-1, 9)]], at=5)]
    df = spark.createDataFrame(data, BLOCK_SCHEMA).repartition(5)
    x = entries(df)
    for ours, theirs in ((row_counts, matrix.row_stats), (col_counts, matrix.col_stats)):
        assert sorted(map(tuple, ours(df).collect())) == sorted(map(tuple, theirs(x).collect())) and ours(df.limit(0)).count() == 0
    near = entries(df, chunk=8)
    assert rows(near) == rows(x)
    places = near.select((near.row_id / 8).cast("int").alias("chunk"), spark_partition_id().alias("part")).distinct()
    assert places.count() == places.select("chunk").distinct().count() == 5
