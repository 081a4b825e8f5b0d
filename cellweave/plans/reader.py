"""Opening a stored dataset and selecting rows or columns of it."""

from __future__ import annotations

import os
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.config import settings
from cellweave.functions.index import normalize_column_indices, normalize_row_indices
from cellweave.functions.scalars import available_memory
from cellweave.operators import matrix
from cellweave.operators.ids import dense_rank
from cellweave.plans import store

#: Share of the free memory that a local result may take.
MEMORY_SHARE = 0.8


@dataclass
class Csr:
    """A matrix in compressed sparse row form, on the driver."""

    data: np.ndarray
    indices: np.ndarray
    indptr: np.ndarray
    shape: tuple[int, int]

    def to_scipy(self):
        from scipy.sparse import csr_matrix

        return csr_matrix((self.data, self.indices, self.indptr), shape=self.shape)

    def toarray(self) -> np.ndarray:
        out = np.zeros(self.shape)
        np.add.at(out, (np.repeat(np.arange(self.shape[0]), np.diff(self.indptr)), self.indices), self.data)
        return out


def to_csr(rows: pa.Table, ids: Sequence[int], ncols: int, key: str, other: str) -> Csr:
    """Entries on the driver as a matrix whose rows are ``ids`` in order; repeated coordinates add up."""
    width = max(ncols, 1)
    own, across, val = (rows.column(c).to_numpy() for c in (key, other, "val"))
    place = np.searchsorted(np.asarray(ids, np.int64), own) if len(ids) else np.zeros(0, np.int64)
    code, at = np.unique(place * width + across, return_inverse=True)
    data = np.bincount(at, val.astype(np.float64), len(code)) if len(code) else np.zeros(0)
    indptr = np.concatenate(([0], np.cumsum(np.bincount(code // width, minlength=len(ids)))))
    return Csr(data, code % width, indptr, (len(ids), ncols))


@dataclass
class Selection:
    """Entries with values as doubles, the metadata of their rows, that of the columns, and the shape.

    ``x`` has row_id, col_id and val; ``obs`` has one row per selected row and ``kept``, false
    with null metadata for rows that the quality filter left out.
    """

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    shape: tuple[int, int]
    row_ids: Sequence[int] | None = None
    col_ids: Sequence[int] | None = None

    def csr(self) -> Csr:
        if self.row_ids is not None:
            return to_csr(self.x.toArrow(), self.row_ids, self.shape[1], "row_id", "col_id")
        raise ValueError("a column selection is read with Dataset.columns_csr")

    def to_anndata(self):
        import anndata

        return anndata.AnnData(X=self.csr().to_scipy(), obs=self.obs.orderBy("row_id").toPandas(), var=self.var.orderBy("`index`").toPandas())


class ObsView:
    """Row metadata by position: ``obs[5, :]``, ``obs[2:7, :]``."""

    def __init__(self, df: DataFrame, size: int = 8_192):
        self.df, self.size = df, size
        self._starts: tuple[np.ndarray, np.ndarray] | None = None

    def _chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the chunks of row ids that hold rows, rows before each and in all); counted once, on one narrow column."""
        if self._starts is None:
            counts = self.df.groupBy(F.floor(F.col("_row_index") / self.size).alias("chunk")).agg(F.count(F.lit(1)).alias("n")).orderBy("chunk").collect()
            self._starts = np.array([r["chunk"] for r in counts], np.int64), np.concatenate(([0], np.cumsum([r["n"] for r in counts]))).astype(np.int64)
        return self._starts

    def _placed(self, ids) -> DataFrame:
        """The rows at sorted positions, with ``_pos``: only chunks that hold one are read, and only those are ordered."""
        if "_row_index" not in self.df.columns:
            return matrix.select_ids(dense_rank(self.df, [self.df.columns[0]], "_pos"), ids, "_pos")
        chunk, start = self._chunks()
        at = np.unique(np.concatenate([np.arange(np.searchsorted(start, lo, "right") - 1, np.searchsorted(start, hi, "right")) for lo, hi in matrix.runs(ids)])) if len(ids) else np.zeros(0, np.int64)
        if not len(at):
            return self.df.where(F.lit(False)).withColumn("_pos", F.lit(0).cast("long"))
        spans = [(int(chunk[k]) * self.size, int(chunk[k] + 1) * self.size - 1) for k in at.tolist()]
        near = self.df.where(matrix.among(F.col("_row_index"), spans)).withColumn("_chunk", F.floor(F.col("_row_index") / self.size))
        before = self.df.sparkSession.createDataFrame([(int(chunk[k]), int(start[k])) for k in at.tolist()], "_chunk long, _before long")
        own = Window.partitionBy("_chunk").orderBy("_row_index")
        near = near.join(F.broadcast(before), "_chunk").withColumn("_pos", F.row_number().over(own) - 1 + F.col("_before")).drop("_chunk", "_before")
        return matrix.select_ids(near, ids, "_pos")

    def __len__(self) -> int:
        return self.df.count()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __getitem__(self, key: Any) -> pd.DataFrame:
        if not (isinstance(key, tuple) and len(key) == 2 and isinstance(key[1], slice) and key[1] == slice(None)):
            raise ValueError("Obs indexing must be in format [rows, :]")
        ids = normalize_row_indices(key[0], len(self))
        rows = self._placed(ids).orderBy("_pos").toPandas()
        index = rows["_row_index"] if "_row_index" in rows else rows["_pos"]
        return rows.drop(columns="_pos").set_index(pd.Index(index, name=None))

    def __repr__(self) -> str:
        n, k = self.shape
        return f"ObsView of {n} rows and {k} columns: {', '.join(self.columns)}"


class Dataset:
    """A stored dataset. Selections are DataFrames; only the methods that say so bring results here."""

    def __init__(self, spark: SparkSession, path: str):
        if not os.path.exists(path):
            raise FileNotFoundError(f"no dataset at {path}")
        if not os.path.isdir(path):
            raise ValueError(f"{path} is not a directory")
        if not os.path.isfile(os.path.join(path, store.META)):
            raise FileNotFoundError(f"{path} has no {store.META}")
        self.spark, self.path, self.meta = spark, path, store.read_meta(path)
        lacking = [k for k in ("shape", "num_chunks_rm", "max_rows_per_chunk", "obs", "var") if k not in self.meta]
        if lacking:
            raise ValueError(f"the description of {path} lacks {', '.join(lacking)}")
        for part in (self.meta["obs"], self.meta["var"]):
            if not os.path.exists(os.path.join(path, part)):
                raise FileNotFoundError(f"{path} has no {part}")
        self.obs_table = spark.read.parquet(os.path.join(path, self.meta["obs"]))
        self.var_table = spark.read.parquet(os.path.join(path, self.meta["var"]))
        self._names: list[str] | None = None
        self._view: ObsView | None = None
        self._parts: dict[str, DataFrame] = {}

    shape = property(lambda self: tuple(self.meta["shape"]))
    num_rows = property(lambda self: self.meta["shape"][0])
    num_columns = property(lambda self: self.meta["shape"][1])

    @property
    def obs(self) -> ObsView:
        if self._view is None:
            self._view = ObsView(self.obs_table, self.meta["max_rows_per_chunk"])
        return self._view

    @property
    def genes(self) -> list[str]:
        """Names of the columns in order; one per column, read once."""
        if self._names is None:
            self._names = [r[0] for r in self.var_table.orderBy("`index`").select("gene").collect()]
        return self._names

    # --- selections -----------------------------------------------------------------------
    def row_ids(self, index: Any) -> Sequence[int]:
        ids = normalize_row_indices(index, self.num_rows)
        if settings.warn_on_large_queries and len(ids) > settings.large_query_threshold:
            warnings.warn(f"{len(ids)} rows are asked for", UserWarning, stacklevel=3)
        return ids

    def col_ids(self, index: Any) -> Sequence[int]:
        named = isinstance(index, str) or (isinstance(index, slice) and (isinstance(index.start, str) or isinstance(index.stop, str))) or (not isinstance(index, (slice, int, np.integer, np.ndarray)) and any(isinstance(v, str) for v in index))
        if not named and isinstance(index, np.ndarray):
            named = index.dtype.kind in "UO"
        ids = normalize_column_indices(index, self.num_columns, self.genes if named else None)
        if not ids:
            raise ValueError("no column is selected")
        return ids

    def _part(self, name: str) -> DataFrame:
        """A layout, whose directories are listed once."""
        if name not in self._parts:
            self._parts[name] = store.read_part(self.spark, self.path, name)
        return self._parts[name]

    def row_entries(self, ids: Sequence[int]) -> DataFrame:
        x = self._part("x_rm")
        return matrix.select_ids(x, ids, "row_id", ("row_chunk", self.meta["max_rows_per_chunk"])).drop("row_chunk")

    def col_entries(self, ids: Sequence[int]) -> DataFrame:
        if not self.meta.get("columns_too"):
            raise FileNotFoundError(f"{self.path} has no column layout")
        x = self._part("x_cm")
        return matrix.select_ids(x, ids, "col_id", ("col_chunk", self.meta["max_columns_per_chunk"])).drop("col_chunk")

    def read_rows(self, index: Any) -> DataFrame:
        """(row_id, cols, vals): one row per position asked for, in no order, empty rows included."""
        ids = self.row_ids(index)
        return matrix.pack(self.row_entries(ids), matrix.id_table(self.spark, ids))

    def read_columns(self, index: Any) -> DataFrame:
        """(col_id, rows, vals) of the columns asked for, empty ones included."""
        ids = self.col_ids(index)
        return matrix.pack(self.col_entries(ids), matrix.id_table(self.spark, ids, "col_id", "int"), "col_id", "row_id", ("rows", "vals"))

    def row_pointers(self, index: Any) -> DataFrame:
        """What ``rows_csr`` has as pointers, with the sum of places and values of each of its rows; nothing comes to the driver."""
        ids = self.row_ids(index)
        return matrix.pointers(self.row_entries(ids), ids, summed=self.meta.get("summed", False))

    def column_pointers(self, index: Any) -> DataFrame:
        """The same of ``columns_csr``."""
        ids = self.col_ids(index)
        return matrix.pointers(self.col_entries(ids), ids, "col_id", "row_id", self.meta.get("summed", False))

    def rows(self, index: Any) -> Selection:
        """Selected rows over all columns, with their metadata joined by row id."""
        ids = self.row_ids(index)
        if not ids:
            raise ValueError("no row is selected")
        return Selection(self.row_entries(ids).withColumn("val", F.col("val").cast("double")), self._obs_of(ids), self.var_table, (len(ids), self.num_columns), row_ids=ids)

    def columns(self, index: Any, kept_only: bool = True) -> Selection:
        """Selected columns over the kept rows (or all), as cells x genes."""
        ids = self.col_ids(index)
        x = self.col_entries(ids).withColumn("val", F.col("val").cast("double"))
        obs = self.obs_table.withColumn("row_id", F.col("_row_index"))
        n = self.num_rows
        if kept_only and self.meta.get("kept_rows", n) != n:
            x = x.join(obs.select("row_id"), "row_id", "left_semi")
            n = self.meta["kept_rows"]
        return Selection(x, obs, matrix.select_ids(self.var_table.withColumnRenamed("index", "col_id"), ids, "col_id").withColumnRenamed("col_id", "index"), (n, len(ids)), col_ids=ids)

    def __getitem__(self, key: Any) -> Selection:
        """Names select columns, anything else rows."""
        if isinstance(key, str) or (isinstance(key, slice) and (isinstance(key.start, str) or isinstance(key.stop, str))) or (isinstance(key, list) and key and all(isinstance(v, str) for v in key)):
            return self.columns(key)
        return self.rows(key)

    def _obs_of(self, ids: Sequence[int]) -> DataFrame:
        obs = self.obs_table.withColumn("row_id", F.col("_row_index"))
        mine = matrix.select_ids(obs, ids, "row_id").withColumn("kept", F.lit(True))
        return matrix.id_table(self.spark, ids).join(mine, "row_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))

    # --- local results --------------------------------------------------------------------
    def rows_csr(self, index: Any) -> Csr:
        ids = self.row_ids(index)
        return to_csr(self._local(self.row_entries(ids), len(ids), self.num_columns), ids, self.num_columns, "row_id", "col_id")

    def columns_csr(self, index: Any) -> Csr:
        """Genes as rows, cells as columns."""
        ids = self.col_ids(index)
        return to_csr(self._local(self.col_entries(ids), len(ids), self.num_rows), ids, self.num_rows, "col_id", "row_id")

    def _local(self, x: DataFrame, k: int, width: int) -> pa.Table:
        """The entries on the driver, if the memory guard lets them."""
        self._guard(x, k, width)
        return (x.coalesce(settings.max_workers) if settings.max_workers else x).toArrow()

    def _guard(self, x: DataFrame, k: int, width: int) -> None:
        """MemoryError for more than the free memory allows; entries are counted only if even full rows might not fit."""
        free = available_memory()
        if matrix.memory_estimate(k * width, k)["bytes"] <= MEMORY_SHARE * free:
            return
        need = matrix.memory_estimate(x.count(), k)["bytes"]
        if need <= MEMORY_SHARE * free:
            return
        text = f"the result takes about {need / 1e9:.1f} GB, {free / 1e9:.1f} GB are free"
        if not settings.override_memory_check:
            raise MemoryError(text)
        warnings.warn(text, ResourceWarning, stacklevel=3)

    def random_rows(self, n: int, seed: int | None = None) -> list[int]:
        return matrix.random_rows(n, self.num_rows, seed)

    def estimate_memory(self, row_indices: Any = None, column_indices: Any = None) -> dict[str, float]:
        """Entries and bytes of a selection, from the stored counts; rows win if both are given."""
        if row_indices is not None:
            ids = normalize_row_indices(row_indices, self.num_rows)
            table, key = self.obs_table, "_row_index"
        elif column_indices is not None:
            ids = self.col_ids(column_indices)
            table, key = self.var_table, "index"
        else:
            return matrix.memory_estimate(self.meta["nnz_total"], self.num_rows)
        if "nnz" not in table.columns:
            raise ValueError("the metadata has no nnz")
        nnz = matrix.select_ids(table, ids, key).agg(F.sum("nnz")).collect()[0][0]
        if nnz is None:
            raise ValueError("nothing is known about the selection")
        return matrix.memory_estimate(int(nnz), len(ids))

    def close(self) -> None:
        """Nothing is held open."""
