import numpy as np
import pytest

from cellweave.operators import profile

OBS = "_row_index long, load_no int, barcode string, _source_file string, scrnaseq_protocol string, rows int"
PROTOCOLS = [("p1", "[AC]{4}"), ("p2", "[0-9]+"), (None, "x"), ("p3", None)]


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(PROTOCOLS, "scrnaseq_protocol string, barcode_pattern string")


def test_malformed_values(spark, ref, monkeypatch):
    f = "12345678_a.zarr"
    rows = [
        (1, 1, "ACAC", f, "p1", 0), (2, 1, "ACACA", f, "p1", 0), (3, 1, "12", f, "p1", 0), (4, 1, "12", f, None, 0), (5, 1, "ACAC", f, None, 0), (6, 1, "zz", f, None, 0), (7, 1, None, f, "p1", 0),
        (8, 1, "ACAC\n", f, "p1", 0), (9, 1, "ACAC", f + "\n", "p1", 0), (10, 1, "ACAC", "", "p1", 0), (11, 1, "ACAC", None, "unknown", 0), (12, 1, "", f, "p2", 0), (None, None, "7", "A", "p2", 0),
    ]
    df = spark.createDataFrame(rows, OBS)
    got = {(r.row_index, r.column_name) for r in profile.found(df, ref).collect() if r.measure == "pattern"}
    checked = profile.checked(df, ref).collect()
    monkeypatch.setattr(profile, "MOST_PROTOCOLS", 1)  # too many for an expression: joined
    assert sorted(map(tuple, profile.checked(df, ref).collect()), key=str) == sorted(map(tuple, checked), key=str)
    assert got == {(2, "barcode"), (3, "barcode"), (6, "barcode"), (8, "barcode"), (9, "_source_file"), (10, "_source_file"), (11, "barcode"), (12, "barcode"), (None, "_source_file")}


def load(n, size, nulls, top, rng):
    files = ["12345678_a.zarr"] * int(size * top) + [f"{10_000_000 + i % 40}_b.h5ad" for i in range(size)]
    return [(n * 10_000 + i, n, None if i < size * nulls else "".join(rng.choice(list("AC"), 4)), files[i], "p1", 0) for i in range(size)]


def test_changes_between_loads(spark, ref):
    rng = np.random.default_rng(0)
    rows = load(1, 400, 0.02, 0.3, rng) + load(2, 400, 0.05, 0.35, rng) + load(5, 400, 0.2, 0.35, rng) + load(6, 300, 0.2, 0.7, rng) + [(1, None, "ACAC", None, "p1", 0)]
    df = spark.createDataFrame(rows, OBS)
    got = sorted((r.load_no, r.column_name, r.measure) for r in profile.found(df, ref).collect() if r.row_index == -1)
    assert got == [(5, "barcode", "null_share"), (6, "_source_file", "top_share")]
    test = {(r.load_no, r.column_name): r for r in profile.two_sample_test(profile.checked(df, ref)).collect()}
    assert {k[0] for k in test} == {2, 5, 6}
    assert test[2, "barcode"].auc < 0.58 and test[6, "barcode"].auc > 0.65 and test[6, "barcode"].z > 5
    assert test[6, "_source_file"].drop > 0.1 > test[6, "barcode"].drop and test[5, "barcode"].drop > test[5, "_source_file"].drop


def test_base_aggregates_and_empty(spark, ref):
    rows = [(1, 1, "ACAC", "A", "p1", 0), (2, 1, "ACAC", None, "p1", 0), (3, 1, "CC", None, "p1", 0), (4, None, None, "B", None, 0)]
    df = profile.checked(spark.createDataFrame(rows, OBS), ref)
    got = {(r.load_no, r.column_name): (r.n_rows, r.nulls, r.malformed, r.least, r.greatest, r.top_rows, r.n_distinct) for r in profile.base_aggregates(df).collect()}
    assert got == {(1, "barcode"): (3, 0, 1, "ACAC", "CC", 2, 2), (1, "_source_file"): (3, 2, 1, "A", "A", 1, 1), (None, "barcode"): (1, 1, 0, None, None, 0, 0), (None, "_source_file"): (1, 0, 1, "B", "B", 1, 1)}
    empty = spark.createDataFrame([], OBS)
    assert profile.found(empty, ref).collect() == [] and profile.base_aggregates(profile.checked(empty, ref)).collect() == []
    assert len(profile.found(spark.createDataFrame(rows, OBS), ref.limit(0)).collect()) == 5


def test_auc():
    assert profile._auc(np.array([0.1, 0.2, 0.9]), np.array([0.0, 0.0, 1.0]), np.ones(3)) == 1.0
    assert profile._auc(np.zeros(4), np.array([0, 1, 0, 1.0]), np.ones(4)) == 0.5


def test_no_share_differs_by_more_than_the_discrimination_says():
    rng = np.random.default_rng(4)
    for _ in range(500):
        k = int(rng.integers(1, 9))
        now, then = rng.integers(0, 30, k), rng.integers(0, 30, k)
        if now.sum() and then.sum():
            most = np.abs(now / now.sum() - then / then.sum()).max()
            assert profile.alone_auc(now, then) >= 0.5 + most / 2 - 1e-12


def test_without_the_classifier_no_load_is_reported(spark, ref, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(load(1, 300, 0.02, 0.3, rng) + load(2, 300, 0.3, 0.3, rng) + load(3, 300, 0.3, 0.8, rng), OBS)
    found = lambda: {(r.load_no, r.measure) for r in profile.found(df, ref).collect() if r.row_index == -1}
    assert found() == {(2, "null_share"), (3, "top_share")}
    monkeypatch.setattr(profile, "two_sample_test", lambda rows, *_: spark.createDataFrame([], profile._TEST))
    assert found() == set()
    blind = lambda rows, *_: spark.createDataFrame([(n, c, 0.5, 0.0, 0.5, 0.0, 0.5) for n in (2, 3) for c in ("barcode", "_source_file")], profile._TEST)
    monkeypatch.setattr(profile, "two_sample_test", blind)
    assert found() == set()


def test_changes_within_the_pattern_and_many_columns(spark, ref):
    rng = np.random.default_rng(2)
    rows = []
    for n, (letters, size) in enumerate([("AC", 4), ("AC", 4), ("AC", 9), ("GT", 9)], 1):
        rows += [(n * 10_000 + i, n, "".join(rng.choice(list(letters), size)), f"{10_000_000 + i % 900}_b.h5ad", f"p{i % 3}", i % 2) for i in range(900)]
    checked = profile.checked(spark.createDataFrame(rows, OBS), ref)
    more = checked.withColumn("third", (checked["row_index"] % 10_000).cast("string")).withColumn("third_ok", checked["row_index"].isNotNull())
    for table, columns in ((checked, ("barcode", "_source_file")), (more, ("barcode", "_source_file", "third"))):
        test = {(r.load_no, r.column_name): r for r in profile.two_sample_test(table, columns).collect()}
        assert len(test) == 3 * len(columns)
        assert test[2, "barcode"].auc < 0.56 and test[3, "barcode"].auc > 0.9 and test[4, "barcode"].auc > 0.9  # length, then alphabet
        assert test[3, "barcode"].drop > 0.3 and abs(test[3, "_source_file"].drop) < 0.05


def test_changes_far_behind_in_long_texts(spark, ref):
    """Loads whose texts begin alike differ by letters, kinds of characters or length after 80 characters only."""
    rng = np.random.default_rng(6)
    rows = []
    for n, (letters, size) in enumerate([("AC", 20), ("AC", 20), ("GT", 20), ("GT", 45), ("G7", 45)], 1):
        rows += [(n * 10_000 + i, n, "ACGT" * 20 + "".join(rng.choice(list(letters), size)), "12345678_a.zarr", "p1", 0) for i in range(600)]
        rows += [(n * 10_000 + 600 + i, n, "AC" * 40 + "".join(rng.choice(list(letters), size)), "12345678_a.zarr", "p1", 0) for i in range(300)]
    test = {r.load_no: r for r in profile.two_sample_test(profile.checked(spark.createDataFrame(rows, OBS), ref)).collect() if r.column_name == "barcode"}
    assert test[2].auc < 0.56
    assert test[3].auc > 0.6 and test[4].auc > 0.9 and test[5].auc > 0.9  # alphabet of the last 300, length, kinds
    assert all(test[n].z > 5 and test[n].drop > 0.1 for n in (3, 4, 5))
