import datetime as dt
import math

import numpy as np
import pytest

from cellweave.llm.percentiles import Summary, combine, exact_quantiles, far_outside, file_percentiles, quantiles, summarise


@pytest.mark.parametrize("k", [4, 16, 64])
def test_merged_summaries_keep_their_bound(k):
    rng = np.random.default_rng(k)
    parts = [rng.choice([0, 1, 5], n) if n % 2 else rng.normal(size=n) for n in rng.integers(0, 400, 9)]
    whole = Summary(k)
    for p in parts:
        s = Summary(k)
        for piece in np.array_split(p, 3):
            s.add(piece)
        whole.merge(Summary.of(k, *s.row()))
    values = np.sort(np.concatenate(parts))
    assert whole.n == len(values) and sum(n << level for level, n in enumerate(whole.row()[3])) == len(values)
    for rank in range(1, len(values) + 1, 7):
        low, high = whole.bounds(rank)
        assert low <= values[rank - 1] <= high
    for q in (0.1, 0.5, 0.9):
        got, want = whole.quantile(q), math.ceil(q * len(values))
        lo, hi = np.searchsorted(values, got, "left") + 1, np.searchsorted(values, got, "right")
        assert lo - whole.error <= want <= hi + whole.error
    assert Summary().quantile(0.5) is None


def test_exact_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.integers(0, 60, 3000).astype(float), "few": np.array([3.0]), "ties": np.full(500, 7.0), "wide": rng.normal(size=900)}
    rows = [(g, "m", float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "grp string, measure string, value double").repartition(6)
    got = {r.grp: (r.n, r.p25, r.p75) for r in exact_quantiles(df, {"p25": (1, 4), "p75": (3, 4)}, k=32).collect()}
    want = {g: (len(v), np.sort(v)[math.ceil(len(v) / 4) - 1], np.sort(v)[math.ceil(3 * len(v) / 4) - 1]) for g, v in groups.items()}
    assert got == want
    est = {(r.grp, r.q): (r.value, r.error) for r in quantiles(combine(summarise(df, 32), 32), [0.5], 32).collect()}
    for g, v in groups.items():
        value, error = est[g, 0.5]
        lo, hi = np.searchsorted(np.sort(v), value, "left") + 1, np.searchsorted(np.sort(v), value, "right")
        assert lo - error * len(v) <= math.ceil(len(v) / 2) <= hi + error * len(v) and error < 0.3
    assert exact_quantiles(df.limit(0), {"p25": (1, 4)}).collect() == []


def test_more_tasks_than_one_step_takes(spark, monkeypatch):
    from cellweave.llm import percentiles

    monkeypatch.setattr(percentiles, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    values = rng.permutation(5000).astype(float)
    df = spark.createDataFrame([("g", "m", float(v)) for v in values], "grp string, measure string, value double").repartition(20)
    states = summarise(df, 16)
    assert states.count() == 20
    rows = combine(states, 16).collect()
    assert [r.n for r in rows] == [5000] and rows[0].error > 0
    got = exact_quantiles(df, {"p25": (1, 4), "p75": (3, 4)}, k=16).collect()
    assert [(r.p25, r.p75) for r in got] == [(1249.0, 3749.0)]


def test_hot_groups_are_joined_salted_or_broadcast(spark, monkeypatch):
    from cellweave.llm import percentiles

    f = ["12345678_a.zarr", "12345678_b.zarr"]
    rows = [obs_row(i, f[i % 3 == 0], 1, i % 97, float(i % 89)) for i in range(4000)] + [obs_row(9000, f[0], 1, 5000, 1.0)]
    df = spark.createDataFrame(rows, "_row_index long, _source_file string, load_no int, nnz long, total_counts float, loaded_at timestamp, value string")
    plain = far_outside(df)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    real = percentiles.join_checked
    monkeypatch.setattr(percentiles, "join_checked", lambda a, b, on, **kw: real(a, b, on, most=0, **kw))
    salted = far_outside(df)
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect())) and (9000, "nnz") in {tuple(r) for r in plain.collect()}


def obs_row(i, file, load, nnz, total):
    return (i, file, load, nnz, total, dt.datetime(2020, 1, 1), "x")


def test_far_outside(spark):
    f = "12345678_a.zarr"
    rows = [obs_row(i, f, 1, 100 + i, 1000.0) for i in range(8)]
    rows += [obs_row(8, f, 1, 10_000, 1.0), obs_row(8, f, 2, 105, 9_999.0), obs_row(9, f, 1, None, float("nan")), obs_row(10, f, 1, -1, -5.0), obs_row(11, f + "\n", 1, 9_999, 1.0), obs_row(12, None, 1, 9_999, 1.0), obs_row(13, f, None, 9_999, 1000.0), obs_row(None, f, 1, 9_999, 1.0), obs_row(14, f, 3, 20, None)]
    df = spark.createDataFrame(rows, "_row_index long, _source_file string, load_no int, nnz long, total_counts float, loaded_at timestamp, value string")
    assert sorted(map(tuple, far_outside(df).collect())) == [(8, "total_counts"), (13, "nnz"), (14, "nnz")]
    assert far_outside(df.limit(0)).collect() == []
    assert {r.n for r in file_percentiles(df).collect()} == {11, 10}
