import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.scalars import decode_category, natural, parse_value, quantise, row_range, scaling_factor
from cellweave.operators import align, ids, matrix, obs


def x_of(spark, entries):
    return spark.createDataFrame(entries, "row_id long, col_id int, val long")


def test_selection_equals_filter_for_all_forms(spark):
    rng = np.random.default_rng(0)
    data = [(int(r), int(c), int(v)) for r, c, v in zip(rng.integers(0, 300, 2000), rng.integers(0, 40, 2000), rng.integers(1, 9, 2000))]
    x = x_of(spark, data).withColumn("row_chunk", (F.col("row_id") / 16).cast("int")).cache()
    for wanted in ([5], list(range(10, 60)), [1, 5, 9], sorted(set(rng.integers(0, 300, 80).tolist())), [], list(range(0, 300, 2))):
        got = sorted((r.row_id, r.col_id, r.val) for r in matrix.select_ids(x, wanted, "row_id", ("row_chunk", 16)).collect())
        assert got == sorted(e for e in data if e[0] in set(wanted))


def test_pack_keeps_empty_rows_and_repeats(spark):
    x = x_of(spark, [(1, 7, 2), (1, 3, 1), (1, 7, 5), (9, 0, 1)])
    got = {r.row_id: (r.cols, r.vals) for r in matrix.pack(x, matrix.id_table(spark, [0, 1, 2])).collect()}
    assert got == {0: ([], []), 1: ([3, 7, 7], [1, 2, 5]), 2: ([], [])}
    assert sorted(map(tuple, matrix.unpack(matrix.pack(x, matrix.id_table(spark, [1, 9]))).collect())) == [(1, 3, 1), (1, 7, 2), (1, 7, 5), (9, 0, 1)]


def test_more_rows_than_any_limit(spark):
    x = spark.range(0, 6000).select(F.col("id").alias("row_id"), F.lit(0).alias("col_id"), F.lit(1).cast("long").alias("val"))
    wanted = list(range(0, 6000, 2)) + list(range(1, 6000, 3))
    assert matrix.select_ids(x, sorted(set(wanted))).count() == len(set(wanted))


def test_stack_stats_and_shape(spark):
    a, b = x_of(spark, [(0, 0, 1), (1, 1, 2)]), x_of(spark, [(0, 1, 3)])
    assert sorted(map(tuple, matrix.vstack([(a, 2), (b, 1)]).collect())) == [(0, 0, 1), (1, 1, 2), (2, 1, 3)]
    assert sorted(map(tuple, matrix.hstack([(a, 2), (b, 2)]).collect())) == [(0, 0, 1), (0, 3, 3), (1, 1, 2)]
    assert sorted(map(tuple, matrix.in_shape(x_of(spark, [(0, 0, 1), (2, 0, 1), (0, 5, 1), (-1, 0, 1)]), 2, 5).collect())) == [(0, 0, 1)]
    assert sorted(map(tuple, matrix.row_stats(x_of(spark, [(0, 0, 0), (0, 1, 3)])).collect())) == [(0, 2, 3.0)]
    assert sorted(map(tuple, matrix.transpose(a).collect())) == [(0, 0, 1), (1, 1, 2)]


def test_random_rows():
    assert matrix.random_rows(3, 10, 1) == matrix.random_rows(3, 10, 1)
    assert sorted(matrix.random_rows(20, 10)) == list(range(10))
    with pytest.raises(ValueError):
        matrix.random_rows(-1, 10)


def test_quantise_and_parse(spark):
    df = spark.createDataFrame([(v,) for v in (-3.0, 0.4, 0.5, 2.5, 65535.2, 1e9, float("nan"), float("inf"))], "v double")
    assert [r[0] for r in df.select(quantise(F.col("v"))).collect()] == [0, 0, 1, 3, 65535, 65535, 0, 65535]
    texts = spark.createDataFrame([(t,) for t in ("3", "2.5e1", None, "", "nan", "inf", "-Infinity", "abc", "-7")], "t string")
    assert [r[0] for r in texts.select(parse_value(F.col("t"))).collect()] == [3.0, 25.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, -7.0]
    totals = spark.createDataFrame([(4.0,), (0.0,), (None,)], "t float")
    assert [r[0] for r in totals.select(scaling_factor(F.col("t"))).collect()] == [2500.0, None, None]


def test_categories(spark):
    df = spark.createDataFrame([(c, k) for c in (-1, 0, 1, 2) for k in (["a", "b"], [])], "c int, k array<string>")
    got = {(r.c, len(r.k)): r.v for r in df.withColumn("v", decode_category(F.col("c"), F.col("k"))).collect()}
    assert got == {(-1, 2): None, (0, 2): "a", (1, 2): "b", (2, 2): None, (-1, 0): None, (0, 0): None, (1, 0): None, (2, 0): None}


def test_names():
    assert natural(["rows_1048576_2.mtx", "rows_0_131072.mtx", "rows_131072_262144.mtx"]) == ["rows_0_131072.mtx", "rows_131072_262144.mtx", "rows_1048576_2.mtx"]
    assert row_range("x/cols_5_9.mtx") == (5, 9) and row_range("a.mtx") is None


def test_dense_rank(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert sorted((r.k, r.pos) for r in ids.dense_rank(df, ["k"], "pos", 7).collect()) == [(i, i) for i in range(101)]
    assert ids.dense_rank(df.limit(0), ["k"]).count() == 0


def test_alignment(spark):
    target = align.gene_list(spark, [" B ", "A", "", "C", "A"])
    assert sorted(map(tuple, target.collect())) == [("A", 3 - 0), ("B", 0), ("C", 2)]
    genes = spark.createDataFrame([(0, "A", 0), (0, "X", 1), (0, "A", 2), (1, "C", 0), (1, None, 1)], "source int, gene string, old_col int")
    mapping = align.gene_map(genes, target)
    assert sorted(map(tuple, mapping.collect())) == [(0, 2, 3), (1, 0, 2)]
    x = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 2, 5), (0, 1, 1, 9), (1, 0, 0, 4)], "source int, row_id long, col_id int, val long")
    assert sorted(map(tuple, align.remap(x, mapping).select("source", "row_id", "col_id", "val").collect())) == [(0, 0, 3, 5), (1, 0, 2, 4)]
    with pytest.raises(ValueError):
        align.gene_list(spark, [" "])


def test_obs_policies(spark):
    a = spark.createDataFrame([(1, "x", 1.5)], "n int, only_a string, v float")
    b = spark.createDataFrame([(2**40, "y", "t")], "n long, only_b string, v string")
    outer = obs.concat_obs([a, b])
    assert dict(outer.dtypes) == {"n": "bigint", "only_a": "string", "v": "string", "only_b": "string"}
    assert sorted(tuple(str(v) for v in r) for r in outer.collect()) == [("1", "x", "1.5", "None"), ("1099511627776", "None", "t", "y")]
    inner = obs.concat_obs([a.withColumn("_source_file", F.lit("a")), b.withColumn("_source_file", F.lit("b"))], "inner")
    assert inner.columns == ["n", "v", "_source_file"]
    assert obs.concat_obs([a, b], "columns", ["n"]).columns == ["n"]
    assert obs.concat_obs([a], "columns", ["nothing"]) is a
    for bad in (lambda: obs.concat_obs([]), lambda: obs.concat_obs([a, b], "other"), lambda: obs.concat_obs([a, b], "columns", ["only_a"]), lambda: obs.concat_obs([a.select("only_a"), b.select("only_b")], "inner")):
        with pytest.raises(ValueError):
            bad()


def test_statistics_replace_source_columns(spark):
    o = spark.createDataFrame([(0, 7), (1, 7)], "row_id long, nnz long")
    stats = spark.createDataFrame([(0, 3, 5.0)], "row_id long, nnz long, total_counts float")
    got = {r.row_id: (r.nnz, r.total_counts, r.scaling_factor) for r in obs.with_statistics(o, stats).collect()}
    assert got == {0: (3, 5.0, 2000.0), 1: (0, 0.0, None)}
