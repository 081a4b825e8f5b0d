"""Matrices as coordinates (``row_id``, ``col_id``, ``val``): selection, packing, statistics, sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.config import settings
from cellweave.functions.scalars import size_units
from cellweave.operators.ids import source_offsets

#: Positions up to which a list is written into the filter; Parquet pushes down as many.
IN_LIST = 10
#: Positions that are summed up in one window.
SPAN = 65_536


def runs(ids: Sequence[int]) -> list[tuple[int, int]]:
    """Sorted positions as runs (first, last) of neighbours."""
    if not len(ids):
        return []
    if isinstance(ids, range):
        return [(ids[0], ids[-1])]
    a = np.asarray(ids)
    cuts = np.flatnonzero(np.diff(a) != 1)
    return list(zip(a[np.concatenate(([0], cuts + 1))].tolist(), a[np.concatenate((cuts, [len(a) - 1]))].tolist()))


def _chunk_runs(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Runs of the chunk numbers that sorted runs of positions lie in."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        lo, hi = lo // size, hi // size
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def among(column: F.Column, spans: list[tuple[int, int]], most: int = 1_000) -> F.Column:
    """Is the column within one of the runs? Beyond ``most`` runs the nearest ones are taken together, so it says yes too often, never too rarely."""
    if len(spans) > most:
        gaps = np.array([b[0] - a[1] for a, b in zip(spans, spans[1:])])
        keep = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
        starts, ends = [0, *(keep + 1)], [*keep, len(spans) - 1]
        spans = [(spans[a][0], spans[b][1]) for a, b in zip(starts, ends)]
    single = [lo for lo, hi in spans if lo == hi]
    tests = ([column.isin(single)] if len(single) > 1 or (single and len(spans) == 1) else [column == single[0]] if single else []) + [column.between(lo, hi) for lo, hi in spans if lo != hi]
    while len(tests) > 1:  # a balanced tree of ORs: deep ones overflow the planner
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def id_table(spark: SparkSession, ids: Sequence[int], name: str = "row_id", kind: str = "bigint") -> DataFrame:
    """The positions asked for as a table; long lists come from ranges, not from literals."""
    spans = runs(ids)
    if not spans:
        return spark.createDataFrame([], f"{name} {kind}")
    if len(spans) == 1:
        return spark.range(spans[0][0], spans[0][1] + 1).select(F.col("id").cast(kind).alias(name))
    table = spark.createDataFrame(spans, "lo long, hi long")
    return table.select(F.explode(F.sequence("lo", "hi")).alias("id")).select(F.col("id").cast(kind).alias(name))


def select_ids(x: DataFrame, ids: Sequence[int], name: str = "row_id", chunk: tuple[str, int] | None = None) -> DataFrame:
    """Entries whose ``name`` is among sorted positions.

    One run becomes a range, few positions a list, both pushed to the scan; many are a semi join,
    broadcast while their number is bounded. ``chunk`` = (partition column, size) adds the
    filter on partition directories.
    """
    spark = x.sparkSession
    spans = runs(ids)
    if not spans:
        return x.where(F.lit(False))
    out = x
    if chunk:
        column, size = chunk
        out = out.where(among(F.col(column), _chunk_runs(spans, size)))
    if len(spans) == 1:
        return out.where(F.col(name).between(*spans[0]))
    if len(ids) <= IN_LIST:
        return out.where(F.col(name).isin(list(ids)))
    wanted = id_table(spark, ids, name, x.schema[name].dataType.simpleString())
    out = out.where(F.col(name).between(ids[0], ids[-1]))
    return out.join(F.broadcast(wanted) if len(ids) <= settings.broadcast_rows else wanted, name, "left_semi")


def sum_duplicates(x: DataFrame) -> DataFrame:
    """One entry per coordinate, values added."""
    return x.groupBy("row_id", "col_id").agg(F.sum("val").alias("val"))


def pack(x: DataFrame, ids: DataFrame, key: str = "row_id", other: str = "col_id", names: tuple[str, str] = ("cols", "vals")) -> DataFrame:
    """One row per position of ``ids`` with arrays in order; positions without entries have empty arrays.

    Repeated coordinates stay as they are. The result is as large as its longest row, as asked.
    """
    kind = f"array<struct<{other}:{x.schema[other].dataType.simpleString()},val:{x.schema['val'].dataType.simpleString()}>>"
    rows = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(other, "val"))).alias("e"))
    rows = ids.join(rows, key, "left").withColumn("e", F.coalesce("e", F.array().cast(kind)))
    return rows.select(key, F.col(f"e.{other}").alias(names[0]), F.col("e.val").alias(names[1]))


def pointers(x: DataFrame, ids: Sequence[int], key: str = "row_id", other: str = "col_id", summed: bool = False) -> DataFrame:
    """(position, first, last, places, total): where the entries of each of the sorted ``ids`` begin and end in compressed form, and the sums of their ``other`` and values.

    Repeated coordinates add up; entries that have none (``summed``) are counted where they are. Only one number per ``SPAN`` positions passes through one task.
    """
    spans = runs(ids)
    before = np.cumsum([0] + [hi - lo + 1 for lo, hi in spans])[:-1].tolist()
    table = x.sparkSession.createDataFrame([(*span, n) for span, n in zip(spans, before)], "lo long, hi long, before long")
    at = table.select(F.explode(F.sequence("lo", "hi")).alias(key), "lo", "before").select(key, (F.col("before") + F.col(key) - F.col("lo")).alias("position"))
    sums = (x if summed else sum_duplicates(x)).groupBy(F.col(key).cast("long").alias(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(other).cast("double")).alias("places"), F.sum(F.col("val").cast("double")).alias("total"))
    rows = at.join(sums, key, "left").na.fill(0, ["n", "places", "total"]).withColumn("span", F.floor(F.col("position") / SPAN))
    offsets = source_offsets(rows.groupBy("span").agg(F.sum("n").alias("n_rows")), "span")
    own = Window.partitionBy("span").orderBy("position")
    rows = rows.join(F.broadcast(offsets.select("span", "row_offset")), "span").withColumn("last", F.sum("n").over(own) + F.col("row_offset"))
    return rows.select("position", (F.col("last") - F.col("n")).alias("first"), "last", "places", "total")


def unpack(packed: DataFrame, key: str = "row_id", other: str = "col_id", names: tuple[str, str] = ("cols", "vals")) -> DataFrame:
    """Entries of packed rows."""
    return packed.select(key, F.explode(F.arrays_zip(*names)).alias("e")).select(key, F.col(f"e.{names[0]}").alias(other), F.col(f"e.{names[1]}").alias("val"))


def transpose(x: DataFrame) -> DataFrame:
    """Rows become columns; nothing moves until it is clustered anew."""
    return x.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "val")


def row_stats(x: DataFrame) -> DataFrame:
    """(row_id, nnz, total_counts) over stored entries, zeros counted, before quantisation."""
    return x.groupBy("row_id").agg(F.count(F.lit(1)).alias("nnz"), F.sum("val").cast("float").alias("total_counts"))


def col_stats(x: DataFrame) -> DataFrame:
    """(col_id, nnz) over stored entries."""
    return x.groupBy("col_id").agg(F.count(F.lit(1)).alias("nnz"))


def chunk_stats(x: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """(chunk, start, end, blocks) of the chunks that hold entries; ``end`` is included."""
    number = F.floor(F.col(key) / F.lit(size)).cast("int")
    return x.groupBy(number.alias("chunk")).agg(F.min(key).alias("start"), F.max(key).alias("end"), F.count(F.lit(1)).alias("nnz"))


def in_shape(x: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Entries within the shape; others are left out without a word."""
    return x.where(F.col("row_id").between(0, nrows - 1) & F.col("col_id").between(0, ncols - 1))


def hstack(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices side by side: (entries, number of columns) each, in order."""
    out, offset = None, 0
    for x, ncols in parts:
        moved = x.select("row_id", (F.col("col_id") + F.lit(offset)).alias("col_id"), "val")
        out = moved if out is None else out.unionByName(moved)
        offset += ncols
    if out is None:
        raise ValueError("nothing to join")
    return out


def vstack(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices one below the other: (entries, number of rows) each, in order."""
    out, offset = None, 0
    for x, nrows in parts:
        moved = x.select((F.col("row_id") + F.lit(offset)).cast("long").alias("row_id"), "col_id", "val")
        out = moved if out is None else out.unionByName(moved)
        offset += nrows
    if out is None:
        raise ValueError("nothing to join")
    return out


def random_rows(n: int, nrows: int, seed: int | None = None) -> list[int]:
    """``min(n, nrows)`` distinct positions, unsorted; the same seed gives the same ones."""
    if n < 0:
        raise ValueError("the number of rows cannot be negative")
    return [int(i) for i in np.random.default_rng(seed).choice(nrows, size=min(n, nrows), replace=False)]


def memory_estimate(nnz: int, k: int | None = None) -> dict[str, float]:
    """Bytes of a result in compressed sparse form: 12 per entry and, per selection of k, 4 * (k + 1)."""
    return {"nnz": nnz, **size_units(12 * nnz + (4 * (k + 1) if k is not None else 0))}


def missing(names: DataFrame, have: DataFrame, on: str) -> DataFrame:
    """Names without a partner."""
    return names.join(have, on, "left_anti")
