"""Building a stored dataset out of source files."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.config import settings
from cellweave.functions.scalars import natural, quantise, row_range
from cellweave.operators import align, matrix
from cellweave.operators.ids import global_rows, source_offsets
from cellweave.operators.obs import SOURCE_COLUMNS, kept, with_statistics
from cellweave.plans import store
from cellweave.sources import blockfile, mtx, readers
from cellweave.sources.files import Source, discover, open_source


def default_gene_list() -> str:
    """Path of the standard gene list, from CELLWEAVE_GENE_LIST; none is part of the package."""
    path = os.environ.get("CELLWEAVE_GENE_LIST")
    if not path or not os.path.isfile(path):
        raise FileNotFoundError("name a gene list, or set CELLWEAVE_GENE_LIST")
    return path


def manifest(sources: Sequence[Source], sizes: Sequence[int]) -> list[dict[str, Any]]:
    """Where each source's rows lie."""
    out, at = [], 0
    for s, n in zip(sources, sizes):
        out.append({"source_no": s.number, "file": s.name, "file_path": s.path, "file_type": s.kind, "row_start": at, "row_end": at + n, "n_rows": n})
        at += n
    return out


def read_manifest(path: str) -> list[dict[str, Any]]:
    """Sources of a manifest; older ones name ``zarr_files`` and ``zarr_file`` instead of ``source_files`` and ``file``."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if "sources" in data:
        return data["sources"]
    out, seen = [], set()
    for part in data.get("mtx_files", []):
        for s in part.get("source_files") or part.get("zarr_files") or []:
            name = s.get("file") or s.get("zarr_file")
            if name and name not in seen:
                seen.add(name)
                out.append({"file": name})
    return out


def in_manifest(sources: Sequence[Source], path: str) -> list[Source]:
    """The sources that a manifest names, in their order; others are left out, a named one that is missing is a ValueError."""
    named = {s["file"] for s in read_manifest(path)}
    lacking = named - {s.name for s in sources}
    if lacking:
        raise ValueError(f"the manifest names sources that are not there: {', '.join(sorted(lacking))}")
    return [s for s in sources if s.name in named]


def rows_in_manifest(rows: DataFrame, entries: DataFrame, on: str = "_source_file") -> DataFrame:
    """Metadata rows whose source was aligned; ``entries`` has ``file``, one row per source."""
    return rows.join(F.broadcast(entries.select(F.col("file").alias(on)).distinct()), on, "left_semi")


def align_sources(spark: SparkSession, sources: Sequence[Source], genes: Sequence[str], rows_per_task: int = readers.ROWS_PER_TASK) -> tuple[DataFrame, DataFrame, list[int]]:
    """(entries by global row and list column, offsets of the sources, rows of each source), values as in the sources."""
    opened = [open_source(s.path) for s in sources]
    sizes = [o.n_rows for o in opened]
    names = {s.number: o.genes() for s, o in zip(sources, opened)}
    mapping = align.gene_map(readers.source_genes(spark, names), align.gene_list(spark, list(genes)))
    offsets = source_offsets(spark.createDataFrame([(s.number, n) for s, n in zip(sources, sizes)], "source_no int, n_rows long"))
    raw = readers.read_matrix(spark, sources, sizes, rows_per_task).withColumnRenamed("source_no", "source")
    aligned = align.remap(raw, mapping).withColumnRenamed("source", "source_no")
    x = global_rows(aligned, F.broadcast(offsets)).select("row_id", "col_id", "val")
    return x, offsets, sizes


def _policy(types: dict[int, dict[str, pa.DataType]], strategy: str, join_on: Sequence[str] | None) -> dict[str, pa.DataType]:
    """Columns of the joined metadata and their types."""
    if strategy not in ("outer", "inner", "columns"):
        raise ValueError(f"unknown strategy {strategy!r}: outer, inner or columns")
    every = list(dict.fromkeys(n for t in types.values() for n in t))
    if len(types) > 1 and strategy == "inner":
        every = sorted(set.intersection(*(set(t) for t in types.values())))
        if not every:
            raise ValueError("the sources have no column in common")
    if len(types) > 1 and strategy == "columns":
        every = list(dict.fromkeys(join_on or []))
        for number, t in types.items():
            lacking = [c for c in every if c not in t]
            if lacking:
                raise ValueError(f"source {number} lacks the columns {', '.join(lacking)}")
    out = {}
    for name in every:
        kinds = {t[name] for t in types.values() if name in t}
        if len(kinds) == 1:
            out[name] = kinds.pop()
        else:
            out[name] = pa.float64() if all(pa.types.is_integer(k) or pa.types.is_floating(k) for k in kinds) else pa.string()
    return out


def build_obs(spark: SparkSession, sources: Sequence[Source], sizes: Sequence[int], offsets: DataFrame, stats: DataFrame, strategy: str = "outer", join_on: Sequence[str] | None = None) -> DataFrame:
    """All rows' metadata with source columns, statistics and ``_row_index``, nothing filtered yet."""
    opened = {s.number: open_source(s.path) for s in sources}
    for s, n in zip(sources, sizes):
        if opened[s.number].n_obs not in (None, n):
            raise ValueError(f"{s.name} has {n} rows but metadata of {opened[s.number].n_obs}")
    types = {number: source.obs_types() for number, source in opened.items()}
    columns = _policy(types, strategy, join_on)
    columns = {n: k for n, k in columns.items() if n not in (*SOURCE_COLUMNS, "nnz", "total_counts", "scaling_factor", "_row_index")}
    rows = readers.read_obs(spark, sources, sizes, columns, {n: list(t) for n, t in types.items()})
    names = spark.createDataFrame([(s.number, s.name if s.kind == "zarr" else None, s.name if s.kind == "h5ad" else None) for s in sources], "source_no int, _source_zarr string, _source_file string")
    rows = rows.join(F.broadcast(names), "source_no")
    rows = rows.drop(*[c for c, kind in (("_source_zarr", "zarr"), ("_source_file", "h5ad")) if not any(s.kind == kind for s in sources)])
    rows = with_statistics(global_rows(rows, F.broadcast(offsets)), stats)
    return rows.withColumnRenamed("row_id", "_row_index").drop("source_no", "local_row").select("_row_index", *[F.col(f"`{c}`") for c in rows.columns if c not in ("row_id", "source_no", "local_row")])


def _key(parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def build_dataset(
    spark: SparkSession,
    directory: str,
    output: str,
    genes: str | Sequence[str] | None = None,
    block_rows: int | None = None,
    max_rows: int | None = None,
    max_columns: int | None = None,
    obs_strategy: str = "outer",
    obs_join_on: Sequence[str] | None = None,
    obs_name: str = "obs.parquet",
    min_nnz: int | None = None,
    cleanup: bool = True,
    rows_per_task: int = readers.ROWS_PER_TASK,
    only: str | None = None,
) -> dict[str, Any]:
    """Align all sources of a directory (of ``only`` those that this manifest names) and write the dataset; returns its description.

    The aligned entries are staged in ``output/_stage-<key>``, where the key stands for the
    sources' names, sizes and times and the gene list: a build that failed later starts from there,
    one with other inputs does not. ``cleanup`` removes the stage at the end.
    """
    sources = discover(directory)
    if not sources:
        raise ValueError(f"{directory} holds no Zarr or HDF5 source")
    if only:
        sources = [Source(i, s.name, s.path, s.kind) for i, s in enumerate(in_manifest(sources, only))]
    names = readers.read_genes(genes or default_gene_list()) if genes is None or isinstance(genes, str) else [g.strip() for g in genes if g.strip()]
    names = list(dict.fromkeys(reversed(names)))[::-1] if len(set(names)) < len(names) else names
    store.check_parameters(block_rows or settings.block_rows, max_rows or settings.max_rows_per_chunk, max_columns or settings.max_columns_per_chunk)
    x, offsets, sizes = align_sources(spark, sources, names, rows_per_task)
    stage = os.path.join(output, "_stage-" + _key([names, [(s.name, os.path.getmtime(s.path), n) for s, n in zip(sources, sizes)]]))
    try:
        if not os.path.isfile(os.path.join(stage, "_SUCCESS")):
            x.write.mode("overwrite").parquet(stage)
        x = spark.read.schema("row_id long, col_id int, val double").parquet(stage)
        obs = build_obs(spark, sources, sizes, offsets, matrix.row_stats(x), obs_strategy, obs_join_on)
        least = settings.min_nnz if min_nnz is None else min_nnz
        var = align.with_empty_columns(matrix.col_stats(x), align.gene_list(spark, names))
        stored = x.select("row_id", "col_id", quantise(F.col("val")).alias("val"))
        extra = {"sources": manifest(sources, sizes), "min_nnz": least}
        meta = store.write_store(output, stored, kept(obs, least), var, (sum(sizes), len(names)), block_rows, max_rows, max_columns, obs_name=obs_name, extra=extra)
        meta["kept_rows"] = spark.read.parquet(os.path.join(output, obs_name)).count()
        store.write_meta(output, meta)
        with open(os.path.join(output, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump({"sources": extra["sources"], "n_genes": len(names), "column_nnz_file": "column_nnz.txt"}, f, indent=1)
        mtx.write_column_counts(var.select(F.col("index").cast("int").alias("col_id"), "nnz"), os.path.join(output, "column_nnz.txt"), len(names))
    except BaseException:
        raise
    else:
        if cleanup:
            shutil.rmtree(stage, ignore_errors=True)
    return meta


def build_from_mtx(spark: SparkSession, path: str, output: str, genes: Sequence[str] | None = None, min_nnz: int = 0, **options: Any) -> dict[str, Any]:
    """Dataset from a matrix file or a folder of them, one below the other by the numbers in their names.

    All must have the same number of columns.
    """
    paths = [path] if os.path.isfile(path) else natural([os.path.join(path, n) for n in os.listdir(path) if n.endswith(".mtx")])
    if len(paths) > 1 and all(row_range(p) for p in paths):
        paths.sort(key=row_range)
    if not paths:
        raise ValueError(f"{path} holds no .mtx file")
    heads = [mtx.header(p) for p in paths]
    widths = {h[1] for h in heads}
    if len(widths) > 1:
        raise ValueError(f"the matrices differ in their columns: {sorted(widths)}")
    ncols, nrows = widths.pop(), sum(h[0] for h in heads)
    names = list(genes) if genes else [f"col_{i}" for i in range(ncols)]
    if len(names) != ncols:
        raise ValueError(f"{len(names)} gene names for {ncols} columns")
    x = matrix.vstack([(mtx.read_mtx(spark, p), h[0]) for p, h in zip(paths, heads)])
    obs = with_statistics(spark.range(nrows).withColumnRenamed("id", "row_id"), matrix.row_stats(x)).withColumnRenamed("row_id", "_row_index")
    target = spark.createDataFrame(list(zip(names, range(ncols))), "gene string, new_col int")
    var = align.with_empty_columns(matrix.col_stats(x), target)
    stored = x.select("row_id", "col_id", quantise(F.col("val")).alias("val"))
    meta = store.write_store(output, stored, kept(obs, min_nnz), var, (nrows, ncols), **options)
    meta["kept_rows"] = spark.read.parquet(os.path.join(output, meta["obs"])).count()
    store.write_meta(output, meta)
    return meta


def export_blocks(spark: SparkSession, dataset: str, target: str, block_rows: int | None = None) -> int:
    """Write the row layout as block files, one per chunk, each by one task; returns their number."""
    import numpy as np

    meta = store.read_meta(dataset)
    size, ncols, nrows = meta["max_rows_per_chunk"], meta["shape"][1], meta["shape"][0]
    rows = block_rows or meta["block_rows"]
    os.makedirs(target, exist_ok=True)

    def write(key, table):
        chunk = key[0].as_py()
        first = chunk * size
        table = table.filter(table.column("row_id").is_valid())
        row, col, val = (table.column(c).to_numpy() for c in ("row_id", "col_id", "val"))
        order = np.lexsort((col, row))
        n = min(size, nrows - first)
        indptr = np.concatenate(([0], np.cumsum(np.bincount(row[order] - first, minlength=n))))
        blocks = blockfile.write(os.path.join(target, f"{chunk}.bin"), indptr, col[order], val[order], ncols, rows, first)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "blocks": pa.array([blocks], pa.int32())})

    write.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    # one row without entry for each chunk, so that chunks without entries are written too
    chunks = spark.range(meta["num_chunks_rm"]).select(F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("int").alias("col_id"), F.lit(None).cast("int").alias("val"), F.col("id").cast("int").alias("row_chunk"))
    x = store.read_part(spark, dataset, "x_rm").select("row_id", "col_id", "val", "row_chunk").unionByName(chunks)
    return x.groupBy("row_chunk").applyInArrow(write, "chunk int, blocks int").agg(F.count(F.lit(1))).collect()[0][0]
