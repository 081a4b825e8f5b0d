"""Source files of single cells: discovery, and one interface to Zarr directories and HDF5 files.

A source has ``n_rows``, ``genes()``, ``obs_types()``, ``read_x(lo, hi)`` and ``read_obs(lo, hi, …)``, all
of which read only what is asked for.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cellweave.sources import zarr2

HDF5 = (".h5", ".hdf5", ".h5ad")


def file_type(path: str) -> str | None:
    """'zarr', 'h5ad' or None."""
    name = str(path).lower().rstrip("/")
    if name.endswith(".zarr") and os.path.isdir(path):
        return "zarr"
    return "h5ad" if name.endswith(HDF5) and os.path.isfile(path) else None


@dataclass(frozen=True)
class Source:
    number: int
    name: str
    path: str
    kind: str


def discover(directory: str) -> list[Source]:
    """Zarr directories by name, then HDF5 files by name; this is the order of rows."""
    if not os.path.exists(directory):
        raise FileNotFoundError(f"no directory {directory}")
    if not os.path.isdir(directory):
        raise ValueError(f"{directory} is not a directory")
    names = sorted(os.listdir(directory))
    paths = [os.path.join(directory, n) for n in names]
    ordered = [p for p in paths if file_type(p) == "zarr"] + [p for p in paths if file_type(p) == "h5ad"]
    return [Source(i, os.path.basename(p), p, file_type(p)) for i, p in enumerate(ordered)]


def plain_type(dtype: np.dtype) -> pa.DataType:
    if dtype.kind == "b":
        return pa.bool_()
    if dtype.kind in "iu":
        return pa.int64()
    if dtype.kind == "f":
        return pa.float32() if dtype.itemsize <= 4 else pa.float64()
    return pa.string()


class ZarrSource:
    """CSR matrix in ``X``, names in ``var/gene``, metadata in ``obs``."""

    def __init__(self, path: str):
        self.path = path
        for part in ("X/data", "X/indices", "X/indptr"):
            if not zarr2.is_array(os.path.join(path, part)):
                raise ValueError(f"{path} lacks {part}")

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    @property
    def n_rows(self) -> int:
        return len(zarr2.Array(self._at("X", "indptr"))) - 1

    def genes(self) -> list[str]:
        """Names of the columns, plain or as a categorical."""
        at = self._at("var", "gene")
        if zarr2.is_array(at):
            return [str(g) for g in zarr2.Array(at)[:]]
        if zarr2.is_group(at) and zarr2.is_array(os.path.join(at, "categories")):
            return [None if g is None else str(g) for g in self._categorical(at, 0, None)]
        raise ValueError(f"{self.path} lacks var/gene")

    def _categorical(self, at: str, lo: int, hi: int | None) -> np.ndarray:
        """Values of a categorical; codes below 0 or beyond the categories are null."""
        codes = zarr2.Array(os.path.join(at, "codes"))[slice(lo, hi)].astype(np.int64)
        categories = zarr2.Array(os.path.join(at, "categories"))[:].astype(object)
        out = np.full(len(codes), None, object)
        good = (codes >= 0) & (codes < len(categories))
        out[good] = categories[codes[good]]
        return out

    def obs_types(self) -> dict[str, pa.DataType]:
        """Readable columns and their types; ``_index`` and groups that are no categorical are left out."""
        found, sizes = {}, set()
        for name in zarr2.children(self._at("obs")):
            at = self._at("obs", name)
            if name == "_index":
                continue
            if zarr2.is_array(at):
                a = zarr2.Array(at)
                found[name] = plain_type(a.dtype)
                sizes.add(len(a))
            elif zarr2.is_array(os.path.join(at, "categories")) and zarr2.is_array(os.path.join(at, "codes")):
                found[name] = plain_type(zarr2.Array(os.path.join(at, "categories")).dtype)
                sizes.add(len(zarr2.Array(os.path.join(at, "codes"))))
        if not found:
            raise ValueError(f"{self.path} has no readable obs column")
        if len(sizes) > 1:
            raise ValueError(f"obs columns of {self.path} differ in length: {sorted(sizes)}")
        return found

    @property
    def n_obs(self) -> int | None:
        """Rows of the metadata; None without a column."""
        for name in zarr2.children(self._at("obs")):
            at = self._at("obs", name)
            if name != "_index" and (zarr2.is_array(at) or zarr2.is_array(os.path.join(at, "codes"))):
                return len(zarr2.Array(at if zarr2.is_array(at) else os.path.join(at, "codes")))
        return None

    def var_columns(self) -> list[str]:
        return zarr2.children(self._at("var"))

    def read_obs(self, lo: int, hi: int, columns: list[str]) -> dict[str, np.ndarray]:
        out = {}
        for name in columns:
            at = self._at("obs", name)
            out[name] = zarr2.Array(at)[lo:hi] if zarr2.is_array(at) else self._categorical(at, lo, hi)
        return out

    def read_x(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row within the source, column, value) of rows lo .. hi-1."""
        ptr = zarr2.Array(self._at("X", "indptr"))[lo : hi + 1].astype(np.int64)
        base = int(zarr2.Array(self._at("X", "indptr"))[0:1][0])
        a, b = int(ptr[0]) - base, int(ptr[-1]) - base
        col = zarr2.Array(self._at("X", "indices"))[a:b].astype(np.int64)
        val = zarr2.Array(self._at("X", "data"))[a:b].astype(np.float64)
        return np.repeat(np.arange(lo, hi), np.diff(ptr)), col, val


class H5Source:
    """The same for HDF5 files with a CSR, CSC or dense ``X``; needs ``h5py``."""

    def __init__(self, path: str):
        try:
            import h5py
        except ImportError:
            raise ImportError(f"reading {path} needs h5py") from None
        self.path, self._file = path, h5py.File(path, "r")
        self._by_row: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _strings(self, node) -> np.ndarray:
        values = node[:]
        return np.array([v.decode("utf-8") if isinstance(v, bytes) else v for v in values], object) if values.dtype.kind in "OS" else values

    @property
    def n_rows(self) -> int:
        x = self._file["X"]
        return int(x.attrs["shape"][0]) if hasattr(x, "keys") else x.shape[0]

    def genes(self) -> list[str]:
        var = self._file["var"]
        return [str(g) for g in self._strings(var[var.attrs.get("_index", "_index")])]

    def obs_types(self) -> dict[str, pa.DataType]:
        obs = self._file["obs"]
        index = obs.attrs.get("_index", "_index")
        names = [n for n in obs if n not in (index, "__categories")]
        sizes = {len(obs[n]["codes"] if hasattr(obs[n], "keys") else obs[n]) for n in names}
        if len(sizes) > 1:
            raise ValueError(f"obs columns of {self.path} differ in length: {sorted(sizes)}")
        return {n: plain_type((obs[n]["categories"] if hasattr(obs[n], "keys") else obs[n]).dtype) for n in names}

    @property
    def n_obs(self) -> int | None:
        """Rows of the metadata; None without a column."""
        obs = self._file["obs"]
        return next((len(obs[n]["codes"] if hasattr(obs[n], "keys") else obs[n]) for n in obs if n != "__categories"), None)

    def var_columns(self) -> list[str]:
        return list(self._file["var"])

    def read_obs(self, lo: int, hi: int, columns: list[str]) -> dict[str, np.ndarray]:
        out = {}
        for n in columns:
            node = self._file["obs"][n]
            if hasattr(node, "keys"):
                codes, categories = node["codes"][lo:hi].astype(np.int64), self._strings(node["categories"])
                values = np.full(len(codes), None, object)
                good = (codes >= 0) & (codes < len(categories))
                values[good] = categories[codes[good]]
                out[n] = values
            else:
                out[n] = self._strings(node)[lo:hi]
        return out

    def read_x(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self._file["X"]
        if not hasattr(x, "keys"):
            part = x[lo:hi]
            row, col = np.nonzero(part)
            return row + lo, col.astype(np.int64), part[row, col].astype(np.float64)
        kind = x.attrs.get("encoding-type", x.attrs.get("h5sparse_format", "csr"))
        kind = kind.decode() if isinstance(kind, bytes) else kind
        ptr = x["indptr"][:].astype(np.int64)
        if "csc" in kind:
            if self._by_row is None:  # turned round once for each task, then cut by rows
                row = x["indices"][:].astype(np.int64)
                order = np.argsort(row, kind="stable")
                self._by_row = (row[order], np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[order], x["data"][:][order].astype(np.float64))
            a, b = np.searchsorted(self._by_row[0], (lo, hi))
            return tuple(part[a:b] for part in self._by_row)
        a, b = int(ptr[lo]), int(ptr[hi])
        return np.repeat(np.arange(lo, hi), np.diff(ptr[lo : hi + 1])), x["indices"][a:b].astype(np.int64), x["data"][a:b].astype(np.float64)


def open_source(path: str) -> ZarrSource | H5Source:
    kind = file_type(path)
    if kind is None:
        raise ValueError(f"{path} is neither a Zarr directory nor an HDF5 file")
    return ZarrSource(path) if kind == "zarr" else H5Source(path)
