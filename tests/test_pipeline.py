import os

import numpy as np
import pytest

from cellweave import cli
from cellweave.config import settings
from cellweave.plans import check, pipeline, store
from cellweave.plans.reader import Dataset, ObsView
from cellweave.sources import blockfile, mtx, zarr2
from cellweave.sources.files import ZarrSource, discover

GENES = ["G0", "G1", "G2", "G3", "G4"]


def make_zarr(path, x, genes, obs, codec="zstd"):
    """x: dense matrix; obs: name -> values, or (codes, categories)."""
    zarr2.write_group(path)
    for g in ("X", "var", "obs"):
        zarr2.write_group(os.path.join(path, g))
    rows = [np.flatnonzero(r) for r in x]
    zarr2.write_array(f"{path}/X/indptr", np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype("<i8"), 4, codec)
    zarr2.write_array(f"{path}/X/indices", np.concatenate(rows).astype("<i4"), 7, codec)
    zarr2.write_array(f"{path}/X/data", np.concatenate([x[i, r] for i, r in enumerate(rows)]).astype("<f4"), 7, codec)
    zarr2.write_array(f"{path}/var/gene", np.array(genes, object), codec=codec)
    for name, v in obs.items():
        if isinstance(v, tuple):
            zarr2.write_group(f"{path}/obs/{name}")
            zarr2.write_array(f"{path}/obs/{name}/codes", np.array(v[0], "<i1"), codec=codec)
            zarr2.write_array(f"{path}/obs/{name}/categories", np.array(v[1], object), codec=codec)
        else:
            zarr2.write_array(f"{path}/obs/{name}", np.array(v), codec=codec)


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    rng = np.random.default_rng(3)
    a = rng.poisson(0.8, (23, 4)).astype(float)
    a[0, 0], a[1, 1], a[4] = 70000.0, 2.5, 0
    b = rng.poisson(0.8, (9, 3)).astype(float)
    make_zarr(str(d / "b.zarr"), b, ["G4", "ZZ", "G0"], {"barcode": [f"b{i}" for i in range(9)], "n": np.arange(9, dtype="<i8"), "kind": ([0, 1, -1, 5, 0, 0, 1, 1, 0], ["u", "v"])}, None)
    make_zarr(str(d / "a.zarr"), a, ["G1", "G0", "G3", "G1"], {"barcode": [f"a{i}" for i in range(23)], "n": np.arange(23, dtype="<i4"), "extra.col": np.arange(23) / 2.0}, "zlib")
    full = np.zeros((32, 5))
    full[:23, 0], full[:23, 3], full[:23, 1] = a[:, 1], a[:, 2], a[:, 3]  # of a name that stands twice the last column
    full[23:, 4], full[23:, 0] = b[:, 0], b[:, 2]
    return str(d), full


@pytest.fixture(scope="module")
def built(spark, sources, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "ds")
    pipeline.build_dataset(spark, sources[0], out, GENES, block_rows=4, max_rows=8, max_columns=2, min_nnz=1, rows_per_task=5)
    return Dataset(spark, out), np.floor(np.clip(sources[1], 0, 65535) + 0.5), sources[1]


def test_values_shape_and_manifest(built):
    ds, stored, _ = built
    assert ds.shape == (32, 5) and ds.genes == GENES
    assert (ds.rows_csr(slice(None)).toarray() == stored).all()
    assert [(m["file"], m["row_start"], m["row_end"]) for m in ds.meta["sources"]] == [("a.zarr", 0, 23), ("b.zarr", 23, 32)]
    assert ds.meta["nnz_total"] == int((stored > 0).sum() + ((stored == 0) & (built[2] != 0)).sum())
    assert not [n for n in os.listdir(ds.path) if n.startswith("_stage")]


def test_selections(built):
    ds, stored, _ = built
    for index in (3, -1, [0, 9, 31], slice(5, 20), np.arange(32) % 3 == 0, [4]):
        ids = ds.row_ids(index)
        sel = ds[index]
        assert sel.shape == (len(ids), 5) and (sel.csr().toarray() == stored[ids]).all()
    packed = {r.row_id: r.cols for r in ds.read_rows([4, 5]).collect()}
    assert packed[4] == [] and packed[5] == np.flatnonzero(stored[5]).tolist()
    for index, ids in (("G3", [3]), (["G4", "G0"], [0, 4]), (slice("G1", "G3"), [1, 2, 3])):
        assert (ds.columns_csr(index).toarray() == stored[:, ids].T).all()
    assert {r.col_id: len(r.rows) for r in ds.read_columns(["G2", "G0"]).collect()} == {2: 0, 0: int((stored[:, 0] > 0).sum())}
    with pytest.raises(ValueError):
        ds[[]]
    with pytest.raises(IndexError):
        ds["NO"]


def test_metadata_follows_row_ids(built):
    ds, stored, raw = built
    nnz = (raw != 0).sum(1)
    keep = np.flatnonzero(nnz >= 1)
    assert ds.meta["kept_rows"] == len(keep) < 32
    obs = {r._row_index: r for r in ds.obs_table.collect()}
    assert sorted(obs) == keep.tolist()
    for i in keep:
        r = obs[i]
        assert r.barcode == (f"a{i}" if i < 23 else f"b{i - 23}") and r.nnz == nnz[i] and abs(r.total_counts - raw[i].sum()) < 1e-3
        assert r._source_zarr == ("a.zarr" if i < 23 else "b.zarr")
    assert [obs[i].kind for i in range(23, 32) if i in obs] == [k for i, k in enumerate(["u", "v", None, None, "u", "u", "v", "v", "u"]) if 23 + i in obs]
    picked = {r.row_id: (r.kept, r.barcode) for r in ds[[3, 4]].obs.collect()}
    assert picked == {3: (True, "a3"), 4: (False, None)}
    cols = ds["G0"]
    assert cols.shape == (len(keep), 1) and {r.row_id for r in cols.x.collect()} == set(np.flatnonzero(stored[:, 0]).tolist())
    var = {r.gene: r.nnz for r in ds.var_table.collect()}
    assert var == {g: int((raw[:, i] != 0).sum()) for i, g in enumerate(GENES)}


def test_plans_prune(built):
    ds, _, _ = built
    plan = ds.row_entries(list(range(9, 12)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(row_chunk" in plan and "PushedFilters: [IsNotNull(row_id), GreaterThanOrEqual(row_id" in plan
    plan = ds.col_entries([3])._jdf.queryExecution().executedPlan().toString()
    assert "col_chunk" in plan.split("PartitionFilters")[1][:80]


def test_obs_view_and_estimates(built):
    ds, stored, raw = built
    view = ds.obs
    assert view.shape == (ds.meta["kept_rows"], len(view.columns)) and "barcode" in view.columns and str(len(view)) in repr(view)
    assert len(view[0:4, :]) == 4 and view[-1, :].index.tolist() == [31 if 31 in ds.obs_table.toPandas()._row_index.tolist() else view[-1, :].index[0]]
    with pytest.raises(ValueError, match="Obs indexing must be in format"):
        view[3]
    assert isinstance(view, ObsView)
    nnz = (raw != 0).sum(1)
    assert ds.estimate_memory([0, 1])["bytes"] == 12 * int(nnz[:2].sum()) + 12
    assert ds.estimate_memory(column_indices="G0")["nnz"] == int((raw[:, 0] != 0).sum())
    assert ds.estimate_memory()["nnz"] == ds.meta["nnz_total"]
    assert ds.random_rows(4, 2) == ds.random_rows(4, 2)
    ds.close()


def test_guards(built, monkeypatch):
    ds, _, _ = built
    monkeypatch.setattr("cellweave.plans.reader.available_memory", lambda: 10)
    with pytest.raises(MemoryError):
        ds.rows_csr([0, 1])
    with settings.override(override_memory_check=True), pytest.warns(ResourceWarning):
        ds.rows_csr([0, 1])
    with settings.override(large_query_threshold=1), pytest.warns(UserWarning):
        ds.row_ids([0, 1])


def test_opening_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Dataset(spark, str(tmp_path / "no"))
    (tmp_path / "f").write_text("")
    with pytest.raises(ValueError):
        Dataset(spark, str(tmp_path / "f"))
    with pytest.raises(FileNotFoundError):
        Dataset(spark, str(tmp_path))
    store.write_meta(str(tmp_path), {"shape": [1, 1]})
    with pytest.raises(ValueError):
        Dataset(spark, str(tmp_path))
    for bad in ((0, 1, 1), (257, 1, 1), (1, 0, 1), (1, 1, 2_000_000)):
        with pytest.raises(ValueError):
            store.check_parameters(*bad)


def test_block_files_round_trip(spark, built, tmp_path):
    ds, stored, _ = built
    n = pipeline.export_blocks(spark, ds.path, str(tmp_path / "bin"), 3)
    paths = sorted(str(p) for p in (tmp_path / "bin").iterdir())
    assert n == len(paths)
    from cellweave.operators.blocks import entries

    got = np.zeros(stored.shape)
    for r in entries(blockfile.read_blocks(spark, paths).selectExpr("*", "cast(null as timestamp) as written_at")).collect():
        got[r.row_id, r.col_id] = r.val
    assert (got == stored).all()
    with pytest.raises(ValueError):
        blockfile.parse(b"\0" * 32)


def test_chunks_without_entries_are_exported(spark, tmp_path):
    x = spark.createDataFrame([(0, 1, 5), (9, 0, 2)], "row_id long, col_id int, val int")
    meta = {"shape": [12, 3], "max_rows_per_chunk": 4, "num_chunks_rm": 3, "block_rows": 2}
    x.selectExpr("*", "cast(row_id div 4 as int) as row_chunk").write.partitionBy("row_chunk").parquet(str(tmp_path / "x_rm"))
    store.write_meta(str(tmp_path), meta)
    assert pipeline.export_blocks(spark, str(tmp_path), str(tmp_path / "bin")) == 3
    read = blockfile.read_blocks(spark, sorted(str(p) for p in (tmp_path / "bin").iterdir()))
    assert read.selectExpr("sum(nrows_in_block)").collect()[0][0] == 12


def test_obs_strategies(spark, sources):
    src = discover(sources[0])
    x, offsets, sizes = pipeline.align_sources(spark, src, GENES, 10)
    from cellweave.operators import matrix

    stats = matrix.row_stats(x)
    inner = pipeline.build_obs(spark, src, sizes, offsets, stats, "inner")
    assert inner.count() == 32 and set(inner.columns) == {"_row_index", "barcode", "n", "_source_zarr", "nnz", "total_counts", "scaling_factor"}
    only = pipeline.build_obs(spark, src, sizes, offsets, stats, "columns", ["barcode"])
    assert [c for c in only.columns if c in ("barcode", "n", "kind")] == ["barcode"]
    with pytest.raises(ValueError):
        pipeline.build_obs(spark, src, sizes, offsets, stats, "columns", ["kind"])
    with pytest.raises(ValueError):
        pipeline.build_obs(spark, src, sizes, offsets, stats, "other")


def test_check_directory(sources, tmp_path):
    report = check.check_directory(sources[0])
    assert report.gene_counts == {"a.zarr": 3, "b.zarr": 3} and report.union_genes == 5 and report.common_genes == 1
    assert open(report.csv_path).read().splitlines() == ["dataset_name,common_columns,unique_columns", 'a,"barcode, n",extra.col', 'b,"barcode, n",kind']
    assert any("in common" in m for m in report.messages)
    with pytest.raises(FileNotFoundError):
        check.check_directory(str(tmp_path / "none"))
    empty = check.check_directory(str(tmp_path))
    assert empty.csv_path is None and empty.messages and not os.listdir(tmp_path)
    assert cli.main(["check", str(tmp_path / "none")]) == 1


def test_zarr_source(sources):
    z = ZarrSource(os.path.join(sources[0], "a.zarr"))
    row, col, val = z.read_x(3, 6)
    assert set(row.tolist()) <= {3, 5} and len(row) == len(col) == len(val)
    with pytest.raises(ValueError):
        ZarrSource(sources[0])


MTX = "%%MatrixMarket matrix coordinate real general\n% note\n5 10 9\n1 1 2\n5 10 15\n1 1 3\n2 3\n6 1 4\n3 11 4\n3 2 nan\n4 4 1.5e1\n5 10 9\n"


def test_mtx(spark, tmp_path):
    p = tmp_path / "rows_0_5.mtx"
    p.write_text(MTX)
    assert mtx.header(str(p)) == (5, 10, 9)
    got = sorted(map(tuple, mtx.read_mtx(spark, str(p)).collect()))
    assert got == [(0, 0, 2.0), (0, 0, 3.0), (1, 2, 1.0), (2, 1, 0.0), (3, 3, 15.0), (4, 9, 9.0), (4, 9, 15.0)]
    (tmp_path / "rows_5_10.mtx").write_text(MTX)
    out = str(tmp_path / "ds")
    pipeline.build_from_mtx(spark, str(tmp_path), out, max_rows=4)
    ds = Dataset(spark, out)
    dense = ds.rows_csr(slice(None)).toarray()
    assert ds.shape == (10, 10) and dense[0, 0] == 5 and dense[9, 9] == 24 and (dense[:5] == dense[5:]).all()
    mtx.write_mtx(mtx.read_mtx(spark, str(p)), str(tmp_path / "parts"), 5, 10, 7)
    mtx.join_parts(str(tmp_path / "parts"), str(tmp_path / "again.mtx"))
    assert sorted(map(tuple, mtx.read_mtx(spark, str(tmp_path / "again.mtx")).collect())) == got
    (tmp_path / "rows_20_25.mtx").write_text(MTX.replace("5 10 9", "5 11 9", 1))
    with pytest.raises(ValueError, match="differ"):
        pipeline.build_from_mtx(spark, str(tmp_path), out)
    (tmp_path / "bad.txt").write_text("x")
    with pytest.raises(ValueError):
        mtx.header(str(tmp_path / "bad.txt"))


def test_all_zero_matrix(spark, tmp_path):
    p = tmp_path / "z.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\n3 2 0\n")
    pipeline.build_from_mtx(spark, str(p), str(tmp_path / "ds"))
    ds = Dataset(spark, str(tmp_path / "ds"))
    assert ds.rows_csr([0, 2]).toarray().tolist() == [[0, 0], [0, 0]] and ds.columns_csr([1]).shape == (1, 3)


def test_odd_sources(tmp_path):
    x = np.array([[1.0, 0.0], [0.0, 2.0]])
    make_zarr(str(tmp_path / "uneven.zarr"), x, ["A", "B"], {"barcode": ["a", "b"], "short": np.arange(1)})
    with pytest.raises(ValueError, match="differ in length"):
        ZarrSource(str(tmp_path / "uneven.zarr")).obs_types()
    make_zarr(str(tmp_path / "bare.zarr"), x, ["A", "B"], {})
    with pytest.raises(ValueError, match="no readable obs"):
        ZarrSource(str(tmp_path / "bare.zarr")).obs_types()
    make_zarr(str(tmp_path / "cat.zarr"), x, ["A"], {"n": np.arange(2), "_index": ["x", "y"]}, "gzip")
    import shutil

    shutil.rmtree(tmp_path / "cat.zarr" / "var" / "gene")
    zarr2.write_group(str(tmp_path / "cat.zarr" / "var" / "gene"))
    zarr2.write_array(str(tmp_path / "cat.zarr" / "var" / "gene" / "codes"), np.array([1, 0], "<i1"))
    zarr2.write_array(str(tmp_path / "cat.zarr" / "var" / "gene" / "categories"), np.array(["G1", "G2"], object))
    source = ZarrSource(str(tmp_path / "cat.zarr"))
    assert source.genes() == ["G2", "G1"] and list(source.obs_types()) == ["n"]
    report = check.check_directory(str(tmp_path))
    assert report.without_barcode == ["cat.zarr"] and len([m for m in report.messages if "obs" in m]) == 2
    (tmp_path / "x.h5ad").write_bytes(b"no")
    assert any("x.h5ad" in m for m in check.check_directory(str(tmp_path)).messages)


def test_older_manifests(tmp_path):
    (tmp_path / "m.json").write_text('{"mtx_files": [{"zarr_files": [{"zarr_file": "a.zarr"}]}, {"source_files": [{"file": "a.zarr"}, {"file": "b.h5"}]}]}')
    assert [s["file"] for s in pipeline.read_manifest(str(tmp_path / "m.json"))] == ["a.zarr", "b.h5"]


def test_failed_build_resumes_only_with_the_same_inputs(spark, sources, tmp_path, monkeypatch):
    out = str(tmp_path / "ds")

    def broken(*a, **k):
        raise RuntimeError("later")

    with monkeypatch.context() as m:
        m.setattr(pipeline.store, "write_store", broken)
        with pytest.raises(RuntimeError):
            pipeline.build_dataset(spark, sources[0], out, GENES, max_rows=8, max_columns=2)
    stages = [n for n in os.listdir(out) if n.startswith("_stage")]
    assert len(stages) == 1 and os.path.isfile(os.path.join(out, stages[0], "_SUCCESS"))
    meta = pipeline.build_dataset(spark, sources[0], out, GENES[:3], max_rows=8, max_columns=2, min_nnz=0, cleanup=False)
    assert meta["shape"] == [32, 3] and meta["kept_rows"] == 32 and len([n for n in os.listdir(out) if n.startswith("_stage")]) == 2


def test_pointers_are_those_of_local_results_and_need_no_driver(built, spark, monkeypatch):
    from cellweave.operators import matrix
    from cellweave.plans import stored_queries

    ds, _, _ = built
    monkeypatch.setattr(matrix, "SPAN", 3)
    for csr, index, got in [(ds.rows_csr(i), i, ds.row_pointers(i)) for i in (slice(None), [3, 4, 9, 31], [4], [])] + [(ds.columns_csr(i), i, ds.column_pointers(i)) for i in (slice(None), ["G4", "G0"])]:
        at = csr.indptr.tolist()
        expected = [(k, a, b, csr.indices[a:b].sum(), csr.data[a:b].sum()) for k, (a, b) in enumerate(zip(at, at[1:]))]
        assert sorted(tuple(r) for r in got.collect()) == expected, index
    twice = spark.createDataFrame([(7, 1, 2.0), (7, 1, 3.0), (7, 4, 1.0), (9, 0, 1.0)], "row_id long, col_id int, val double")
    assert sorted(tuple(r) for r in matrix.pointers(twice, [5, 7, 9]).collect()) == [(0, 0, 0, 0.0, 0.0), (1, 0, 2, 5.0, 6.0), (2, 2, 3, 0.0, 1.0)]
    monkeypatch.setattr(stored_queries, "dataset", lambda spark, d: ds)
    monkeypatch.setattr("cellweave.plans.reader.to_csr", None)  # columns grow with the cells: none of their entries may come here
    monkeypatch.setattr(Dataset, "col_ids", lambda self, index: range(5))
    assert stored_queries.ds_columns_csr(spark, "").count() == 5
