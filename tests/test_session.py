import os

import pytest

from cellweave import session


def test_checked_join_is_the_same_either_way(spark):
    left = spark.range(100).selectExpr("id", "id % 7 as k")
    right = spark.range(5).selectExpr("id as k", "id * 10 as v")
    for how in ("inner", "left", "left_semi"):
        small = session.join_checked(left, right, "k", how, most=5)
        large = session.join_checked(left, right, "k", how, most=4)
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
        salted = session.join_checked(left, right, "k", how, most=4, salt=5)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    assert session.small_rows(right, 4) is None and len(session.small_rows(right, 5)) == 5


def test_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder
    made = session.local_folder(spark)
    assert os.path.isdir(made) and made.startswith(folder.removeprefix("file:"))
    df = session.cut(spark.range(10).selectExpr("id + 1 as a"))
    assert df.count() == 10 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_read_only_what_is_used(spark):
    df = session.stored(spark.range(100).selectExpr("id", "repeat('x', 50) as wide"))
    assert df.count() == 100 and df.agg({"id": "max"}).collect()[0][0] == 99
    assert "ReadSchema: struct<id:bigint>" in df.select("id")._jdf.queryExecution().executedPlan().toString()


def test_folders_on_other_file_systems(spark, monkeypatch):
    assert session.mounted(spark, "/some/where") == session.mounted(spark, "file:///some/where") == "/some/where"
    monkeypatch.setattr(session, "shared_dir", lambda _: "viewfs:///x")
    monkeypatch.setattr(session, "mounted", lambda *_: None)
    assert session.local_folder(spark) is None


def test_no_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
