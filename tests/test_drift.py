import datetime as dt
import json

from pyspark.sql import functions as F

from cellweave.operators import drift
from cellweave.operators.drift import flood, listed_columns, schema_changes, unified_table

T0 = dt.datetime(2020, 1, 1)
RAW = "_source_file string, delivery_no int, record_no int, delivered_at timestamp, payload string"
REPORT = "report_dir string, dataset_name string, delivery_no int, reported_at timestamp, common_columns string, unique_columns string"


def tables(spark, deliveries):
    """deliveries: (dataset, number) -> list of records; columns are listed in turn as common and as unique."""
    raw, report = [], []
    for (name, n), records in deliveries.items():
        raw += [(name, n, i, T0, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(records)]
        cols = sorted({k for r in records if isinstance(r, dict) for k in r})
        report.append(("d", name, n, T0, " , ".join(cols[::2]) or None, ",".join(f" {c}\t" for c in cols[1::2]) or ""))
    return spark.createDataFrame(raw, RAW), spark.createDataFrame(report + report[:1], REPORT)


def test_changes(spark):
    one = [{"barcode": f"c{i}", "a": i, "gone": "x", "Name": f"n{i}", "t": 1, "empty": None, "swap1": i, "swap2": -i} for i in range(5)]
    two = [{"barcode": f"c{i}", "a": i, "new": 3, "name": f"n{i}", "t": 1.5, "empty": None, "swap3": -i, "swap4": i} for i in range(1, 7)] + [{"barcode": "c1", "name": "n1", "a": 1, "new": 3, "t": 1.5, "empty": None, "swap3": -1, "swap4": 1}, "not json", "[1]", None]
    three = [{"barcode": f"c{i}", "a": None, "new": "3", "name": f"n{i}", "t": 2.5, "empty": 7, "swap3": -i, "swap4": i} for i in range(2, 5)]
    raw, report = tables(spark, {("d1", 1): one, ("d1", 2): two, ("d1", 3): three, ("d2", 1): one, ("d2", 3): two})
    got = sorted(map(tuple, schema_changes(raw, report).collect()))
    assert got == sorted(
        [
            ("d1", 2, "removed", "gone", ""), ("d1", 2, "added", "new", ""), ("d1", 2, "renamed", "name", "Name"), ("d1", 2, "retyped", "t", ""), ("d1", 2, "renamed", "swap3", "swap2"), ("d1", 2, "renamed", "swap4", "swap1"),
            ("d1", 3, "retyped", "new", ""),
        ]
    )
    table = unified_table(raw, report)
    assert table.count() == 5 + 9 + 3 + 5 + 9  # what is no JSON object stays as a record without values
    kinds = dict(table.dtypes)
    assert kinds["a"] == "bigint" and kinds["t"] == "double" and kinds["Name"] == "string" and kinds["new"] == "string"
    row = {(r.dataset_name, r.delivery_no, r.barcode): r for r in table.collect()}["d1", 2, "c3"]
    assert (row["Name"], row["a"], row["t"], row["swap2"]) == ("n3", 3, 1.5, "-3" if kinds["swap2"] == "string" else -3)


def test_a_name_that_comes_back_while_the_renamed_column_is_there(spark):
    one = [{"barcode": f"c{i}", "x": i} for i in range(3)]
    two = [{"barcode": f"c{i}", "y": i} for i in range(3)]
    three = [{"barcode": f"c{i}", "y": i, "x": "new", "x ": "other"} for i in range(3)]
    raw, report = tables(spark, {("d", 1): one, ("d", 2): two, ("d", 3): three})
    assert sorted((r.delivery_no, r.change, r.column_name, r.old_name) for r in schema_changes(raw, report).collect()) == [(2, "renamed", "y", "x"), (3, "added", "x", "")]
    got = {(r.delivery_no, r.barcode): (r.x, r.x_from_3) for r in unified_table(raw, report).collect()}
    assert got[1, "c2"] == got[2, "c2"] == (2, None) and got[3, "c2"] == (2, "new")


def test_nothing_in_common_and_empty(spark):
    raw, report = tables(spark, {("d", 1): [{"barcode": "a", "x": 1}], ("d", 2): [{"barcode": "b", "y": 1}]})
    assert sorted((r.change, r.column_name) for r in schema_changes(raw, report).collect()) == [("renamed", "y")]
    assert schema_changes(raw.limit(0), report.limit(0)).collect() == [] == schema_changes(raw, report.limit(0)).collect()
    assert {r.name for r in listed_columns(report).collect()} == {"barcode", "x", "y"}


def test_kinds_and_texts(spark):
    payload = '{"a":true,"b":3,"c":3.0,"d":3.25,"e":"3","f":{"z":1,"y":[2]},"g":123456789012345678901,"h":1e2,"i":null,"e":"again"," b":4,"":5}'
    df = spark.createDataFrame([(payload,), ("[1]",), ("{",), (None,)], "payload string").select(F.explode(drift.fields()).alias("e"))
    got = {r.n: (r.k, r.t) for r in df.select(F.col("e.name").alias("n"), drift.kind_of(F.col("e.value")).alias("k"), drift.text_of(F.col("e.value"), drift.kind_of(F.col("e.value"))).alias("t")).collect()}
    assert got == {
        "a": ("boolean", "true"), "b": ("integer", "3"), "c": ("number", "3"), "d": ("number", "3.25"), "e": ("string", "3"), "f": ("string", '{"y":[2],"z":1}'),
        "g": ("integer", "123456789012345678901"), "h": ("number", "100"), "i": (None, None),
    }


def test_without_the_flooding_nothing_is_renamed(spark, monkeypatch):
    one = [{"barcode": f"c{i}", "sample_name": f"s{i}", "x": i % 2, "y": i % 2} for i in range(4)]
    two = [{"barcode": f"c{i}", "sample_name_v2": f"s{i}", "x_new": i % 2, "y_new": i % 2} for i in range(4)]
    raw, report = tables(spark, {("d", 1): one, ("d", 2): two})
    rows = drift._columns(raw, report).toArrow().to_pylist()
    got = {c[3]: c[4] for c in drift._dataset_changes(rows)[0] if c[2] == "renamed"}
    assert got == {"sample_name_v2": "sample_name", "x_new": "x", "y_new": "y"}  # x and y are equal: the flooding tells them apart
    real = drift.flood
    monkeypatch.setattr(drift, "flood", lambda *_: {})
    assert not [c for c in drift._dataset_changes(rows)[0] if c[2] == "renamed"]
    monkeypatch.setattr(drift, "flood", lambda a, b: {k: -v for k, v in real(a, b).items()})
    assert {c[3]: c[4] for c in drift._dataset_changes(rows)[0] if c[2] == "renamed"}["x_new"] == "y"


def test_every_record_and_column_stays(spark):
    one = [{"barcode": "a", "x": 1}, {"x": 2}, {"barcode": "b"}, {"barcode": None, "x": 3}, {"barcode": "c", "x": 4, "extra": "e", "Barcode": "z"}]
    raw, report = tables(spark, {("d", 1): one, ("late", 7): [{"barcode": "q", "x": 9}]})
    listed = report.where("dataset_name = 'd'").withColumn("common_columns", F.lit("barcode,x")).withColumn("unique_columns", F.lit(None).cast("string"))
    got = sorted(((r.dataset_name, r.barcode or "", r.x, r.extra) for r in unified_table(raw, listed).collect()), key=str)
    assert got == sorted([("d", "", 2, None), ("d", "", 3, None), ("d", "a", 1, None), ("d", "b", None, None), ("d", "c", 4, "e"), ("late", "q", 9, None)], key=str)


def test_unlisted_columns_beside_a_root_of_their_name(spark):
    one = [{"barcode": "a", "x": 1}]
    two = [{"barcode": "a", "y": 1, "x": "other", "x_unlisted": "third"}]
    raw, report = tables(spark, {("d", 1): one, ("d", 2): two})
    report = report.withColumn("common_columns", F.when(F.col("delivery_no") == 1, "barcode,x").otherwise("barcode,y")).withColumn("unique_columns", F.lit(""))
    row = {r.delivery_no: r for r in unified_table(raw, report).collect()}[2]
    assert row.x == 1 and row.x_unlisted in ("other", "third")


def test_more_columns_than_fit(spark, monkeypatch):
    monkeypatch.setattr(drift, "MOST_COLUMNS", 3)
    raw, report = tables(spark, {("d", 1): [{"barcode": "a", "p": 1, "q": 2, "r": 3, "s": 4, "t": None}], ("d", 2): [{"barcode": "a", "r": 5, "s": 6}]})
    got = {r.delivery_no: r.asDict() for r in unified_table(raw, report).collect()}
    assert set(got[1]) == {"dataset_name", "delivery_no", "barcode", "p", "r", "s", "other_columns"}
    assert got[1]["p"] == 1 and got[1]["other_columns"]["q"] == "2" and got[2]["s"] == 6 and got[2]["other_columns"] == {}


def test_flooding_prefers_alike_columns():
    left = {"sample_name": "string", "tissue_site": "string", "nnz": "integer"}
    right = {"sample_name_v2": "string", "site_of_tissue": "string", "n_entries": "integer"}
    score = flood(left, right)
    for a, b in zip(left, right):
        assert score[a, b] == max(score[a, c] for c in right)
    assert flood({}, right) == {}
