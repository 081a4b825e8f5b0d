"""Block files row by row, HDF5 nodes, matrix text chunks, obs views."""

import io
import json
import os
import sys
import types

import numpy as np
import pytest

from cellweave.operators import matrix
from cellweave.plans import pipeline, store
from cellweave.plans.reader import Dataset, ObsView
from cellweave.sources import blockfile, files, mtx


def matrix_rows(n, ncols, seed=5):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, n)
    indptr = np.concatenate(([0], np.cumsum(sizes)))
    indices = np.concatenate([np.sort(rng.choice(ncols, k, replace=False)) for k in sizes]) if n else np.zeros(0, np.int64)
    return indptr, indices.astype(np.int64), rng.integers(1, 60_000, indptr[-1])


@pytest.mark.parametrize("n,block_rows,seek", [(0, 16, True), (1, 16, True), (37, 16, True), (64, 4, True), (37, 16, False), (50, 1, False)])
def test_block_rows(tmp_path, n, block_rows, seek):
    indptr, indices, data = matrix_rows(n, 90)
    path = str(tmp_path / "x.bin")
    assert blockfile.write(path, indptr, indices, data, 90, block_rows, 1000) == -(-n // block_rows)
    if not seek:
        raw = open(path, "rb").read()
        with open(path, "rb") as f:
            end = sum(size for _, size in blockfile.seek_table(f))
        open(path, "wb").write(raw[:end])
    with open(path, "rb") as f:
        assert (blockfile.seek_table(f) is not None) == seek
        f.seek(0)
        got = [blockfile.parse(b) for b in blockfile.frames(f)]
    assert [b["start_row"] for b in got] == list(range(1000, 1000 + n, block_rows))
    for wanted in (range(990, 1000 + n + 9), range(1000, 1000 + n, 5), []):
        rows = list(blockfile.file_rows(path, wanted))
        assert [r for r, _, _ in rows] == [r for r in wanted if 1000 <= r < 1000 + n]
        for r, c, v in rows:
            a, b = indptr[r - 1000], indptr[r - 999]
            assert c.tolist() == indices[a:b].tolist() and v.tolist() == data[a:b].tolist()


def test_only_the_blocks_asked_for_are_read(tmp_path, monkeypatch):
    indptr, indices, data = matrix_rows(16 * 200, 90)
    path = str(tmp_path / "x.bin")
    blockfile.write(path, indptr, indices, data, 90, 16)
    seen = []
    real = blockfile.parse
    monkeypatch.setattr(blockfile, "parse", lambda frame: seen.append(1) or real(frame))
    assert len(list(blockfile.file_rows(path, [5, 6, 1600, 3199]))) == 4 and len(seen) <= 4


def test_more_rows_than_any_buffer(spark, tmp_path):
    indptr, indices, data = matrix_rows(9_000, 40)
    blockfile.write(str(tmp_path / "0.bin"), indptr, indices, data, 40)
    got = {r.row_id: (r.cols, r.vals) for r in blockfile.read_rows(spark, [str(tmp_path / "0.bin")], [(0, 8_999), (20_000, 20_010)]).collect()}
    assert len(got) == 9_000 and all(got[i][0] == indices[indptr[i] : indptr[i + 1]].tolist() for i in range(0, 9_000, 97))


class Node(dict):
    """Group or array with attributes, as the HDF5 reader sees it."""

    def __init__(self, *args, attrs=None, **kw):
        super().__init__(*args, **kw)
        self.attrs = attrs or {}


class Values:
    def __init__(self, values):
        self.values = np.asarray(values)
        self.dtype, self.shape, self.reads = self.values.dtype, self.values.shape, 0

    def __getitem__(self, s):
        self.reads += 1
        return self.values[s]

    def __len__(self):
        return len(self.values)


def h5_source(tmp_path, monkeypatch, root):
    path = tmp_path / "a.h5ad"
    path.write_bytes(b"")
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda *_: root))
    return files.open_source(str(path))


@pytest.mark.parametrize("layout", ["csr", "csc", "dense"])
def test_hdf5_layouts(tmp_path, monkeypatch, layout):
    indptr, indices, data = matrix_rows(23, 12)
    full = np.zeros((23, 12))
    full[np.repeat(np.arange(23), np.diff(indptr)), indices] = data
    if layout == "dense":
        x = Values(full)
    else:
        a = full if layout == "csr" else full.T
        major, minor = np.nonzero(a)
        x = Node({"indptr": Values(np.concatenate(([0], np.cumsum((a != 0).sum(1))))), "indices": Values(minor), "data": Values(a[major, minor])}, attrs={"shape": (23, 12), "encoding-type": f"{layout}_matrix"})
    obs = Node({"_index": Values(np.arange(23)), "kind": Node({"codes": Values(np.arange(23) % 4 - 1), "categories": Values(np.array([b"u", b"v"], object))}), "n": Values(np.arange(23, dtype=np.int16))}, attrs={"_index": "_index"})
    root = Node({"X": x, "obs": obs, "var": Node({"names": Values(np.array([f"g{i}".encode() for i in range(12)], object))}, attrs={"_index": "names"})})
    source = h5_source(tmp_path, monkeypatch, root)
    assert source.n_rows == source.n_obs == 23 and source.genes()[3] == "g3" and set(source.obs_types()) == {"kind", "n"}
    assert source.read_obs(0, 5, ["kind"])["kind"].tolist() == [None, "u", "v", None, None]
    for lo, hi in ((0, 10), (10, 23), (4, 4), (22, 23)):
        row, col, val = source.read_x(lo, hi)
        got = np.zeros((23, 12))
        got[row, col] = val
        assert (got[lo:hi] == full[lo:hi]).all() and not got[:lo].any() and not got[hi:].any()
    if layout == "csc":
        assert x["indices"].reads == x["data"].reads == 1
    obs["short"] = Values(np.arange(3))
    with pytest.raises(ValueError, match="differ in length"):
        source.obs_types()


def test_matrix_chunks(spark, tmp_path):
    indptr, indices, data = matrix_rows(30, 15)
    row = np.repeat(np.arange(30), np.diff(indptr))
    x = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(row, indices, data)], "row_id long, col_id int, val double")
    entries = [mtx.write_rows(x, str(tmp_path), a, b, 15) for a, b in ((0, 20), (20, 30))]
    assert [e["mtx_file"] for e in entries] == ["rows_0_20.mtx", "rows_20_30.mtx"] and entries[1]["n_rows"] == 10
    stats = (tmp_path / "rows_20_30_stats.txt").read_text().splitlines()
    assert stats[0] == "nnz total_counts" and stats[1:] == [f"{indptr[i + 1] - indptr[i]} {data[indptr[i] : indptr[i + 1]].sum():.6f}" for i in range(20, 30)]
    meta = pipeline.build_from_mtx(spark, str(tmp_path), str(tmp_path / "out"), max_rows=8, max_columns=4)
    got = Dataset(spark, str(tmp_path / "out")).rows_csr(slice(None))
    assert meta["shape"] == [30, 15] and got.indices.tolist() == indices.tolist() and got.data.tolist() == data.tolist()
    mtx.write_column_counts(matrix.col_stats(x), str(tmp_path / "column_nnz.txt"), 15)
    assert (tmp_path / "column_nnz.txt").read_text().split() == [str(n) for n in np.bincount(indices, minlength=15)]


def test_obs_positions_skip_what_was_filtered(spark):
    kept = [i for i in range(100) if i % 7 and not 40 <= i < 60]
    view = ObsView(spark.createDataFrame([(i, f"c{i}") for i in kept], "_row_index long, name string"), size=8)
    assert len(view) == len(kept)
    for index in (0, -1, slice(3, 20), slice(30, None), [0, 5, 50, -2], slice(4, 4)):
        ours = view[index, :]
        expected = np.array(kept)[[index] if isinstance(index, int) else index]
        assert ours["_row_index"].tolist() == sorted(np.atleast_1d(expected).tolist()) and ours.index.tolist() == ours["_row_index"].tolist()


def test_sources_of_a_manifest(spark, tmp_path):
    sources = [files.Source(i, n, n, "zarr") for i, n in enumerate(["a.zarr", "b.zarr", "c.zarr"])]
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"file": "c.zarr"}, {"file": "a.zarr"}]}))
    assert [s.name for s in pipeline.in_manifest(sources, str(tmp_path / "m.json"))] == ["a.zarr", "c.zarr"]
    (tmp_path / "n.json").write_text(json.dumps({"mtx_files": [{"zarr_files": [{"zarr_file": "z.zarr"}]}]}))
    with pytest.raises(ValueError, match="z.zarr"):
        pipeline.in_manifest(sources, str(tmp_path / "n.json"))
    rows = spark.createDataFrame([("a.zarr", 1), ("b.zarr", 2), (None, 3)], "_source_file string, k int")
    assert [r.k for r in pipeline.rows_in_manifest(rows, spark.createDataFrame([("a.zarr",), ("a.zarr",)], "file string")).collect()] == [1]


def test_a_truncated_frame(tmp_path):
    indptr, indices, data = matrix_rows(40, 20)
    path = str(tmp_path / "x.bin")
    blockfile.write(path, indptr, indices, data, 20)
    raw = open(path, "rb").read()
    with open(path, "rb") as f:
        size = blockfile.seek_table(f)[0][1]
    with pytest.raises(ValueError, match="ends too early"):
        list(blockfile.frames(io.BytesIO(raw[: size - 3])))


def test_numbers_of_blocks(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id long, col_id int, val int")
    obs, var = spark.createDataFrame([], "_row_index long, nnz long"), spark.createDataFrame([], "gene string, `index` long, nnz long")
    for nrows, size, block in ((0, 8, 4), (17, 8, 4), (16, 8, 3), (5, 8, 16)):
        meta = store.write_store(str(tmp_path / "s"), empty, obs, var, (nrows, 3), block_rows=block, max_rows=size)
        assert meta["total_blocks_rm"] == sum(-(-min(size, nrows - lo) // block) for lo in range(0, nrows, size))
    assert os.path.isdir(tmp_path / "s")
