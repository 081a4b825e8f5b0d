from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import frequency, topn
from tests.fixtures import BLOCK_SCHEMA, blocks_of, dense


def random_cells(rng, n=60, ncols=30):
    out = []
    for i in range(n):
        k = 0 if i % 9 == 0 else int(rng.integers(1, 20))
        out.append([(int(c), int(v)) for c, v in zip(rng.zipf(1.5, k) % (ncols + 3) - 1, rng.integers(0, 5, k))])
    return out


def test_gene_counts_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    cells = random_cells(rng)
    genes = [(f" g{i % 20} " if i % 3 else f"G{i % 20} ", i, 0) for i in range(30)] + [(None, 30, 0), (" \t", 31, 0), ("only", 40, 0)]
    df = spark.createDataFrame(blocks_of(cells, ncols=30), BLOCK_SCHEMA).repartition(3)
    g = spark.createDataFrame(genes, "gene string, index long, nnz long")
    x = dense(cells, 30)
    expected = {}
    for name in {f"G{i}" for i in range(20)} | {"ONLY"}:
        mine = [i for n, i, _ in genes if n and n.strip().upper() == name and i < 30]
        expected[name] = (sum(c in mine for cell in cells for c, _ in cell), int((x[:, mine].sum(1) > 0).sum()) if mine else 0)
    for heavy in (512, 3, 0):  # how many terms are heavy changes nothing
        monkeypatch.setattr(frequency, "HEAVY", heavy)
        rows = frequency.gene_frequencies(df, g).collect()
        assert {r.gene: (r.entries, r.cells) for r in rows} == expected
        assert {r.all_cells for r in rows} == {len(cells)}
        for r in rows:
            assert r.mark == ("rare" if r.cells < 0.005 * 60 else "common" if r.cells > 30 else "")
    monkeypatch.setattr(frequency, "MOST_COLUMNS", 3)  # a header too wide to hand round
    wide = frequency.gene_frequencies(df, g).collect()
    assert sorted(map(tuple, wide)) == sorted(map(tuple, rows))
    monkeypatch.undo()
    assert {(r.cells, r.mark) for r in frequency.gene_frequencies(df.limit(0), g).collect()} == {(0, "")}
    assert frequency.gene_frequencies(df, g.limit(0)).collect() == []


def test_terms_of_records(spark):
    data = [(["a", "b", "a"], 1), (None, 2), ([], 3), (["a", None, "c" * 5000], 4), (["b"], 5), (["a", "b", "a"], 1)]
    df = spark.createDataFrame(data, "words array<string>, term int")
    n = Counter(w for ws, _ in data for w in (ws or []) if w)
    m = Counter(w for ws, _ in data for w in set(ws or []) if w)
    for heavy in (None, [], ["a"], ["zz"]):
        got = {r.term: (r.entries, r.records) for r in frequency.term_frequencies(df, "words", heavy).collect()}
        assert got == {w: (n[w], m[w]) for w in n}
    assert frequency.term_frequencies(df.limit(0), "words").collect() == []


def best(rows, n):
    out = []
    for g in {r[0] for r in rows}:
        mine = sorted({(-s, i) for gg, s, i in rows if gg == g})[:n]
        out += [(g, k + 1, i, -s) for k, (s, i) in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n_with_ties_repeats_and_a_hot_group(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(g), float(s), int(i)) for g, s, i in zip(rng.integers(0, 50, 900), rng.integers(0, 6, 900), rng.integers(0, 40, 900))]
    rows += [(7, float(s), int(i)) for s, i in zip(rng.integers(0, 3, 800), rng.integers(0, 500, 800))]
    df = spark.createDataFrame(rows + rows[:50], "g long, s double, i long").repartition(5).withColumn("grp", F.lit("x"))
    got = sorted(map(tuple, topn.top_n(df, "g", "s", "i", n).collect()))
    assert got == best(rows, n)


def test_top_n_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (None, 1.0, 1), (1, 2.0, None), (1, float("nan"), 3), (1, -1.0, 4), (-5, 1.0, 2)], "g long, s double, i long")
    assert sorted(map(tuple, topn.top_n(df, "g", "s", "i", 2).collect())) == [(-5, 1, 2, 1.0), (1, 1, 4, -1.0)]
    assert topn.top_n(df, "g", "s", "i", 0).collect() == [] and topn.top_n(df.limit(0), "g", "s", "i", 2).collect() == []


def test_top_genes(spark):
    rng = np.random.default_rng(4)
    cells = random_cells(rng)
    x = dense(cells, 30)
    df = spark.createDataFrame(blocks_of(cells, ncols=30), BLOCK_SCHEMA)
    expected = sorted((i, k + 1, int(c)) for i in range(len(cells)) for k, c in enumerate([c for c in np.lexsort((np.arange(30), -x[i])) if x[i, c] > 0][:3]))
    assert sorted((r.row_index, r.rank_no, r.gene_index) for r in topn.top_genes(df).collect()) == expected


def test_cells_stand_in_several_runs_and_the_merge_decides(spark):
    rng = np.random.default_rng(6)
    cells = [[(int(c), int(v)) for c, v in zip(rng.choice(40, 15, replace=False), rng.integers(1, 9, 15))] for _ in range(30)]
    df = spark.createDataFrame(blocks_of(cells, ncols=40), BLOCK_SCHEMA)
    got = {(r.row_index, r.rank_no): r.gene_index for r in topn.top_genes(df).collect()}
    for stripes in (1, 7):
        assert {(r.row_index, r.rank_no): r.gene_index for r in topn.top_genes(df, 3, stripes).collect()} == got
    taken = {}
    for r in topn._merge(runs_of(topn, df), 10**6).collect():  # without the limit of N, all that the runs hold
        taken.setdefault(r.grp, set()).add(r.item % topn.STRIPES)
    assert sum(len(s) > 1 for s in taken.values()) == 30
    # runs one after the other instead of merged: the result is another one
    rows = [(r.bucket, r.run, r.grp, -r.score, r.item) for r in runs_of(topn, df).collect()]
    first: dict = {}
    for _, _, g, _, i in sorted(rows):
        first.setdefault(g, []).append(i)
    assert {(g, k + 1): i for g, items in first.items() for k, i in enumerate(items[:3])} != got
    assert all(len(items) == 3 * topn.STRIPES or len(items) > 6 for items in first.values())


def runs_of(topn, df):
    """The runs that top_genes merges."""
    held = []
    real = topn._merge
    topn._merge = lambda runs, n: held.append(runs) or real(runs, n)
    try:
        topn.top_genes(df)
    finally:
        topn._merge = real
    return held[0]


def test_buckets_are_merged_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(topn, "GROUPS", 4)
    rng = np.random.default_rng(8)
    rows = [(int(g), float(s), int(i)) for g, s, i in zip(rng.integers(0, 300, 4000), rng.integers(0, 30, 4000), rng.integers(0, 1000, 4000))]
    df = spark.createDataFrame(rows, "g long, s double, i long").repartition(7)
    assert sorted(map(tuple, topn.top_n(df, "g", "s", "i", 4).collect())) == best(rows, 4)


def test_loser_tree_orders_any_runs():
    rng = np.random.default_rng(9)
    for k in range(1, 9):
        runs = [sorted((int(v),) for v in rng.integers(0, 30, rng.integers(0, 12))) for _ in range(k)]
        at = [0] * k
        head = lambda r: runs[r][at[r]] if at[r] < len(runs[r]) else topn.LoserTree.END
        tree, out = topn.LoserTree([head(r) for r in range(k)]), []
        while (key := tree.keys[tree.winner]) is not topn.LoserTree.END:
            out.append(key)
            at[tree.winner] += 1
            tree.replace(head(tree.winner))
        assert out == sorted(v for r in runs for v in r)
