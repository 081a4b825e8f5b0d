"""Row metadata of many sources: policies of joining columns, computed columns, the kept rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.scalars import joined_sorted, scaling_factor

#: Columns that say where a row comes from.
SOURCE_COLUMNS = ("_source_zarr", "_source_file")
_SMALL = (T.ByteType, T.ShortType, T.IntegerType)


def widen_integers(df: DataFrame) -> DataFrame:
    """Small integers become bigint; decimals without fraction (unsigned 64 bit) too, with an overflow error."""
    out = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _SMALL) or (isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0):
            column = column.cast("bigint")
        out.append(column.alias(f.name))
    return df.select(*out)


def _common_type(kinds: list[T.DataType]) -> T.DataType | None:
    """One type for a column over sources; numbers widen, anything else that differs becomes a string."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, (T.LongType, T.FloatType, T.DoubleType)) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def _reconcile(dfs: Sequence[DataFrame]) -> list[DataFrame]:
    """Columns of one name get one type in all frames, cast explicitly."""
    kinds: dict[str, list[T.DataType]] = {}
    for df in dfs:
        for f in df.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)
    target = {name: _common_type(k) for name, k in kinds.items()}
    return [df.select(*[F.col(f"`{f.name}`").cast(target[f.name]).alias(f.name) if f.dataType != target[f.name] else F.col(f"`{f.name}`") for f in df.schema.fields]) for df in dfs]


def _union(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def concat_obs(dfs: Sequence[DataFrame], strategy: str = "outer", join_on: Sequence[str] | None = None) -> DataFrame:
    """Rows of all frames under a policy of columns.

    ``outer`` all columns, nulls where a frame lacks one; ``inner`` the common ones by name, and
    the source columns; ``columns`` exactly ``join_on``, and the source columns. One frame
    is returned as it is. No frame, no common column, a missing column or an unknown policy is
    a ValueError. Types that differ are reconciled: numbers widen, else strings.
    """
    if not dfs:
        raise ValueError("no metadata to join")
    if strategy not in ("outer", "inner", "columns"):
        raise ValueError(f"unknown strategy {strategy!r}: outer, inner or columns")
    if len(dfs) == 1:
        return dfs[0]
    frames = _reconcile([widen_integers(df) for df in dfs])
    if strategy == "outer":
        return _union(frames)
    if strategy == "inner":
        chosen = sorted(set.intersection(*(set(df.columns) for df in frames)) - set(SOURCE_COLUMNS))
        if not chosen:
            raise ValueError("the sources have no column in common")
    else:
        chosen = list(dict.fromkeys(join_on or []))
        if not chosen:
            raise ValueError("strategy 'columns' needs join_on")
        for i, df in enumerate(frames):
            lacking = [c for c in chosen if c not in df.columns]
            if lacking:
                raise ValueError(f"source {i} lacks the columns {', '.join(lacking)}")
    extra = [c for c in SOURCE_COLUMNS if any(c in df.columns for df in frames) and c not in chosen]
    return _union([df.select(*[F.col(f"`{c}`") for c in [*chosen, *(c for c in extra if c in df.columns)]]) for df in frames])


def with_statistics(obs: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds nnz, total_counts and scaling_factor by ``row_id``, over columns of these names; rows without entries get 0."""
    plain = obs.drop("nnz", "total_counts", "scaling_factor")
    out = plain.join(stats.select("row_id", "nnz", "total_counts"), "row_id", "left")
    out = out.withColumn("nnz", F.coalesce("nnz", F.lit(0)).cast("bigint")).withColumn("total_counts", F.coalesce("total_counts", F.lit(0.0)).cast("float"))
    return out.withColumn("scaling_factor", scaling_factor(F.col("total_counts")))


def kept(obs: DataFrame, min_nnz: int) -> DataFrame:
    """Rows with at least ``min_nnz`` entries; row ids stay what they were."""
    return obs.where(F.col("nnz") >= F.lit(min_nnz))


def column_report(columns: dict[str, Sequence[str]]) -> list[tuple[str, str, str]]:
    """(dataset, common columns, its own other columns), names in order and joined by ', '."""
    if not columns:
        return []
    common = set.intersection(*(set(c) for c in columns.values()))
    return [(name, ", ".join(sorted(common)), ", ".join(sorted(set(c) - common))) for name, c in columns.items()]


def column_report_table(listed: DataFrame) -> DataFrame:
    """The same for a table (dataset, column) of any size."""
    distinct = listed.select("dataset", "column").distinct()
    total = distinct.agg(F.count_distinct("dataset").alias("n"))
    counted = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(total), F.lit(True))
    marked = distinct.join(counted.select("column", (F.col("k") == F.col("n")).alias("common")), "column")
    pick = lambda hit: joined_sorted(F.collect_list(F.when(hit, F.col("column"))))
    return marked.groupBy("dataset").agg(pick(F.col("common")).alias("common_columns"), pick(~F.col("common")).alias("unique_columns"))
