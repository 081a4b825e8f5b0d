"""Every command, on small sources, and what it leaves behind."""

import json
import os

import numpy as np
import pytest

from cellweave import cli
from cellweave.sources import zarr2


def source(path, rows, genes, seed):
    rng = np.random.default_rng(seed)
    full = rng.integers(0, 4, (rows, len(genes)))
    row, col = np.nonzero(full)
    for group in ("", "X", "var", "obs"):
        zarr2.write_group(os.path.join(path, group))
    zarr2.write_array(os.path.join(path, "X/indptr"), np.concatenate(([0], np.cumsum((full > 0).sum(1)))))
    zarr2.write_array(os.path.join(path, "X/indices"), col.astype(np.int32))
    zarr2.write_array(os.path.join(path, "X/data"), full[row, col].astype(np.float32))
    zarr2.write_array(os.path.join(path, "var/gene"), np.array(genes, object))
    zarr2.write_array(os.path.join(path, "obs/barcode"), np.array([f"{seed}-{i}" for i in range(rows)], object))
    return full


@pytest.fixture
def folder(tmp_path):
    one = source(str(tmp_path / "src" / "one.zarr"), 9, ["u", "v", "w"], 1)
    two = source(str(tmp_path / "src" / "two.zarr"), 6, ["w", "x"], 2)
    (tmp_path / "genes.txt").write_text("x\nw\nu\n")
    return tmp_path, one, two


def run(capsys, *args):
    assert cli.main([str(a) for a in args]) == 0
    return capsys.readouterr().out


def test_build_info_and_export(spark, folder, capsys):
    at, one, two = folder
    meta = json.loads(run(capsys, "build", at / "src", at / "out", "--genes", at / "genes.txt", "--min-nnz", 1, "--max-rows", 4, "--max-columns", 2, "--block-rows", 2))
    nnz = int((one[:, [0, 2]] > 0).sum() + (two > 0).sum())
    assert meta["shape"] == [15, 3] and meta["nnz_total"] == nnz and json.loads(run(capsys, "info", at / "out")) == meta
    assert (at / "out" / "column_nnz.txt").read_text().split() == [str(int((two[:, 1] > 0).sum())), str(int((one[:, 2] > 0).sum() + (two[:, 0] > 0).sum())), str(int((one[:, 0] > 0).sum()))]
    assert run(capsys, "export-blocks", at / "out", at / "blocks").strip() == "4" and sorted(os.listdir(at / "blocks")) == ["0.bin", "1.bin", "2.bin", "3.bin"]


def test_only_what_a_manifest_names(spark, folder, capsys):
    at, _, two = folder
    (at / "m.json").write_text(json.dumps({"sources": [{"file": "two.zarr"}]}))
    meta = json.loads(run(capsys, "build", at / "src", at / "out", "--genes", at / "genes.txt", "--min-nnz", 0, "--only", at / "m.json"))
    assert meta["shape"] == [6, 3] and meta["nnz_total"] == int((two > 0).sum())
    run(capsys, "obs", at / "src", at / "obs.parquet", "--only", at / "m.json")
    assert sorted(r.barcode for r in spark.read.parquet(str(at / "obs.parquet")).collect()) == [f"2-{i}" for i in range(6)]


def test_align_obs_check_and_matrix_files(spark, folder, capsys):
    at, one, two = folder
    run(capsys, "align", at / "src", at / "genes.txt", at / "x.parquet")
    x = {(r.row_id, r.col_id): r.val for r in spark.read.parquet(str(at / "x.parquet")).collect()}
    assert x == {**{(i, {0: 2, 2: 1}[j]): float(one[i, j]) for i in range(9) for j in (0, 2) if one[i, j]}, **{(9 + i, {0: 1, 1: 0}[j]): float(two[i, j]) for i in range(6) for j in (0, 1) if two[i, j]}}
    run(capsys, "obs", at / "src", at / "obs.parquet", "--strategy", "inner")
    obs = spark.read.parquet(str(at / "obs.parquet")).orderBy("_row_index").collect()
    assert [r.barcode for r in obs] == [f"1-{i}" for i in range(9)] + [f"2-{i}" for i in range(6)] and obs[9].nnz == int((two[0] > 0).sum())
    assert json.loads(run(capsys, "check", at / "src"))["common_genes"] == 1
    (at / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 2 2\n1 2 7\n3 1 5\n")
    assert json.loads(run(capsys, "build-mtx", at / "m.mtx", at / "mtx"))["nnz_total"] == 2


def test_errors(folder, capsys):
    at, _, _ = folder
    for args in (["check", "nowhere"], ["info", "nowhere"], ["align", "src", "no-genes.txt", "x"], ["build-mtx", "src", "y"]):
        assert cli.main([args[0], *(str(at / a) for a in args[1:])]) == 1 and "error:" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
