import ast
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tables(folder):
    c = duckdb.connect()
    for n in sorted(os.listdir(folder)):
        if n.endswith(".parquet"):
            c.sql(f"CREATE VIEW {n[:-8]} AS SELECT * FROM read_parquet('{folder}/{n}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    df = entry.queries()[name](spark, small)
    rel = tables(small).sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in columns]
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (int, float)) else (True, "n", x) for x in r)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert ours == theirs


def test_queries_without_sql_run(spark, small):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, small).count() > 0, name
    assert entry.entry(spark).count() > 0


def test_rest_does_not_import_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "cellweave")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
                assert not any("llm" in n.split(".") for n in names), f


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "cellweave"), tmp_path / "cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k[0] == 'p' and k[1].isdigit()), sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "['p2_drift', 'p2_found', 'p2_profile', 'p6_found', 'p6_table'] []"


def test_workers_find_the_package_from_anywhere(tmp_path, small):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); print('rows', e.queries()['coo_block_entries'](s, {small!r}).count())"
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "CELLWEAVE_LOCAL_SHARED")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("name,pushed", [("row_slice", "GreaterThanOrEqual(l_suppkey"), ("row_list", "In(l_suppkey"), ("col_list", "In(l_partkey"), ("col_by_name", "l_partkey,42"), ("row_long_list", "GreaterThanOrEqual(l_suppkey")])
def test_selections_reach_the_scan(spark, small, name, pushed):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters: ", 1)[1].split("ReadSchema")[0] and "l_shipdate" not in plan
