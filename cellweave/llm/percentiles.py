"""Percentiles of large groups by deterministic buffer collapsing.

A summary is a list of buffers: sorted values that each stand for ``weight`` original
values. ``K`` values make a buffer of weight 1; two buffers of one weight collapse into one
of twice the weight by taking every second value of their merged order, alternately from
the first and the second place. Merging is associative up to a known bound, so summaries
of partitions, loads or days combine in any tree. Each collapse at weight w shifts a rank by
at most w, and the sum of those shifts is carried along as ``error``, so every quantile has
a proven interval of ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import cut, join_checked

#: Values of a buffer.
K = 1024
#: Partial summaries that one step of the merge tree takes together.
FAN_IN = 64
#: Parts that a group is split into where a join cannot be broadcast.
SALT = 32
#: A whole file name.
FILE_PATTERN = r"^[0-9]{8}_[a-z0-9]+\.(zarr|h5ad)\z"


class Summary:
    """Weighted sorted buffers with a bound on the rank error of any value."""

    def __init__(self, k: int = K):
        self.k, self.levels, self.rest, self.n, self.error = k, {}, [], 0, 0
        self._held = 0
        self.flips: dict[int, int] = {}

    def add(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.float64)
        self.n += len(values)
        self.rest.append(values)
        self._held += len(values)
        if self._held >= self.k:
            self._pack()

    def _pack(self) -> None:
        whole = np.concatenate(self.rest)
        full = len(whole) // self.k * self.k
        for i in range(0, full, self.k):
            self._push(0, np.sort(whole[i : i + self.k]))
        self.rest = [whole[full:]]
        self._held = len(whole) - full

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while level in self.levels:
            both = np.sort(np.concatenate((self.levels.pop(level), buffer)))
            flip = self.flips.get(level, 0)
            self.flips[level] = 1 - flip
            buffer = both[flip::2]
            self.error += 1 << level
            level += 1
        self.levels[level] = buffer

    def merge(self, other: Summary) -> None:
        """Take in another summary; errors add up."""
        self.n += other.n
        self.error += other.error
        for level, buffer in sorted(other.levels.items()):
            self._push(level, buffer)
        for values in other.rest:
            self.rest.append(values)
            self._held += len(values)
        if self._held >= self.k:
            self._pack()

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the weight of each."""
        parts = [(np.concatenate(self.rest) if self.rest else np.zeros(0), 1), *((b, 1 << level) for level, b in self.levels.items())]
        value = np.concatenate([v for v, _ in parts])
        weight = np.concatenate([np.full(len(v), w, np.int64) for v, w in parts])
        order = np.argsort(value, kind="stable")
        return value[order], weight[order]

    def bounds(self, rank: int) -> tuple[float, float]:
        """An interval of values that holds the value of this rank (1 .. n)."""
        value, weight = self.points()
        upto = np.cumsum(weight)
        low = np.searchsorted(upto, rank - self.error, "left") - 1  # estimated rank surely too small
        high = np.searchsorted(upto, rank + self.error, "left") + 1
        return (float(value[low]) if low >= 0 else -math.inf), (float(value[high]) if high < len(value) else math.inf)

    def quantile(self, q: float, rank: int | None = None) -> float | None:
        """The value at estimated position ceil(q * n), or at the rank given."""
        if not self.n:
            return None
        value, weight = self.points()
        rank = rank or max(1, math.ceil(q * self.n))
        return float(value[min(np.searchsorted(np.cumsum(weight), rank, "left"), len(value) - 1)])

    def row(self) -> tuple[int, int, list[float], list[int]]:
        """(n, error, values level by level, number of values of each level); level 0 has the loose values too."""
        parts: list[np.ndarray] = []
        for level in range(max(self.levels, default=0) + 1):
            own = [self.levels[level]] if level in self.levels else []
            parts.append(np.concatenate([*own, *(self.rest if level == 0 else [])]) if own or level == 0 else np.zeros(0))
        return self.n, self.error, np.concatenate(parts), [len(x) for x in parts]

    @staticmethod
    def of(k: int, n: int, error: int, value: np.ndarray, size: np.ndarray) -> Summary:
        s = Summary(k)
        s.n, s.error = n, error
        at = np.concatenate(([0], np.cumsum(size)))
        own = value[: at[1]]
        whole = len(own) // k * k  # at most one full buffer of weight 1
        if whole:
            s.levels[0] = np.sort(own[:whole])
        s.rest, s._held = [own[whole:]], len(own) - whole
        for level in range(1, len(size)):
            if size[level]:
                s.levels[level] = value[at[level] : at[level + 1]]
        return s


_STATE = "grp string, measure string, part long, n long, error long, value array<double>, size array<int>"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _lists(parts: list, kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32()), pa.array(flat, kind))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), _lists(list(columns[5]), pa.float64()), _lists(list(columns[6]), pa.int32())], _NAMES)


def _rows(batch: pa.RecordBatch, k: int):
    """(group, measure, part, summary) of each row of a batch of states."""
    value, size = batch.column(5), batch.column(6)
    values, sizes = value.flatten().to_numpy(zero_copy_only=False), size.flatten().to_numpy(zero_copy_only=False)
    v = np.concatenate(([0], np.cumsum(value.value_lengths().to_numpy(zero_copy_only=False))))
    z = np.concatenate(([0], np.cumsum(size.value_lengths().to_numpy(zero_copy_only=False))))
    for i, (grp, measure, part, n, error) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)))):
        yield grp, measure, part, Summary.of(k, n, error, values[v[i] : v[i + 1]], sizes[z[i] : z[i + 1]])


def summarise(values: DataFrame, k: int = K) -> DataFrame:
    """One summary per (grp, measure) and task of ``values`` (grp, measure, value); nothing is shuffled.

    Values are gathered over batches and parted by one sort, so many small groups cost little; a task
    with very many groups gives what it has and starts anew.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        held: dict[tuple, Summary] = {}
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def take() -> None:
            nonlocal waiting, rows
            table = pa.Table.from_batches(waiting).combine_chunks()
            grp, measure = (pa.concat_arrays(table.column(c).chunks).dictionary_encode() for c in ("grp", "measure"))
            m = max(len(measure.dictionary), 1)
            code = grp.indices.to_numpy(zero_copy_only=False).astype(np.int64) * m + measure.indices.to_numpy(zero_copy_only=False)
            value = table.column("value").to_numpy()
            order = np.argsort(code, kind="stable")
            code, value = code[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            names, kinds = grp.dictionary.to_pylist(), measure.dictionary.to_pylist()
            for c, v in zip(code[first].tolist(), np.split(value, first[1:])):
                key = names[c // m], kinds[c % m]
                if key not in held:
                    held[key] = Summary(k)
                held[key].add(v)
            waiting, rows = [], 0

        def give():
            items = list(held.items())
            for at in range(0, len(items), 512):
                yield _batch([(*key, part, *s.row()) for key, s in items[at : at + 512]])
            held.clear()

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 19:
                take()
                if len(held) > 20_000:
                    yield from give()
        if rows:
            take()
        yield from give()

    return values.select("grp", "measure", "value").mapInArrow(run, _STATE)


def _merge_sorted(k: int):
    """Merge the neighbouring states of one (grp, measure, step) of a stream that is ordered by them."""

    def run(batches):
        now, whole, out = None, None, []
        for batch in batches:
            for grp, measure, part, s in _rows(batch, k):
                key = grp, measure, part // FAN_IN
                if key == now:
                    whole.merge(s)
                    continue
                if now is not None:
                    out.append((*now, *whole.row()))
                now, whole = key, s
                if len(out) >= 512:
                    yield _batch(out)
                    out = []
        if now is not None:
            out.append((*now, *whole.row()))
        yield _batch(out)

    return run


def combine(states: DataFrame, k: int = K) -> DataFrame:
    """One summary per (grp, measure), merged in a tree: each step takes at most ``FAN_IN`` tasks' summaries together.

    There are as many steps as the number of tasks asks for. A step's groups are streamed in order, one
    summary in memory.
    """
    states = cut(states)
    most = states.agg(F.max("part")).collect()[0][0] or 0
    while True:
        step = F.floor(F.col("part") / FAN_IN)
        states = states.repartition("grp", "measure", step).sortWithinPartitions("grp", "measure", "part").mapInArrow(_merge_sorted(k), _STATE)
        most //= FAN_IN
        if most == 0:
            return states


def quantiles(summaries: DataFrame, qs: list[float], k: int = K) -> DataFrame:
    """(grp, measure, n, q, value, error): estimates with the proven rank error as a share of n."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = [(grp, measure, s.n, q, s.quantile(q), s.error / s.n) for grp, measure, _, s in _rows(batch, k) for q in qs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["grp", "measure", "n", "q", "value", "error"])

    return summaries.mapInArrow(run, "grp string, measure string, n long, q double, value double, error double")


def exact_quantiles(values: DataFrame, positions: dict[str, tuple[int, int]], k: int = K) -> DataFrame:
    """(grp, measure, n, one column per position): exact order statistics, found from the summaries.

    A position (a, b) is the value at place ceil(n * a / b). The summary gives an interval that
    surely holds it; groups whose summary is exact are done. For the others one pass counts the values
    below and, combined by value, those inside; the place is then read off the few distinct values
    inside. Intervals are broadcast within a bound, else joined salted, so no group stands in one task.
    """

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = []
            for grp, measure, _, s in _rows(batch, k):
                for name, (a, b) in positions.items():
                    rank = -(-s.n * a // b)
                    exact = s.error == 0
                    rows.append((grp, measure, s.n, name, rank, *((s.quantile(a / b, rank),) * 2 if exact else s.bounds(rank)), exact))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], ["grp", "measure", "n", "name", "rank", "low", "high", "exact"])

    ranges = cut(combine(summarise(values, k), k).mapInArrow(run, "grp string, measure string, n long, name string, rank long, low double, high double, exact boolean"))
    keys = ["grp", "measure", "n"]
    done = ranges.where("exact").select(*keys, "name", F.col("low").alias("at"))
    inside = join_checked(values, ranges.where("not exact").drop("exact"), ["grp", "measure"], salt=SALT)
    at = F.when(F.col("value") < F.col("low"), F.lit(None)).otherwise(F.col("value"))
    counted = inside.where("value <= high").groupBy(*keys, "name", "rank", at.alias("at")).agg(F.count(F.lit(1)).alias("here"))
    order = Window.partitionBy("grp", "measure", "name").orderBy(F.asc_nulls_first("at"))
    placed = counted.withColumn("upto", F.sum("here").over(order)).where("at is not null and upto >= rank and upto - here < rank").select(*keys, "name", "at")
    return done.unionByName(placed).groupBy(*keys).pivot("name", list(positions)).agg(F.max("at"))


def cell_measures(obs: DataFrame) -> DataFrame:
    """(row_index, grp, measure, value) of the current row of each cell, with ``grp`` the file.

    Of each ``_row_index`` only the row with the greatest ``load_no`` counts (null loads are
    oldest; equal ones give one row); then only rows whose file fits the pattern; null, NaN and
    negative values are left out. Cells without ``_row_index`` are left out.
    """
    top = F.max(F.struct("load_no", "_source_file", F.col("nnz").cast("double").alias("nnz"), F.col("total_counts").cast("double").alias("total_counts")))
    current = obs.where(F.col("_row_index").isNotNull()).groupBy(F.col("_row_index").alias("row_index")).agg(top.alias("r"))
    fits = current.where(F.col("r._source_file").rlike(FILE_PATTERN))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"r.{m}").alias("value")) for m in ("nnz", "total_counts")])
    flat = fits.select("row_index", F.col("r._source_file").alias("grp"), F.inline(pairs))
    return flat.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") >= 0))


def far_outside(obs: DataFrame, factor: float = 4.0) -> DataFrame:
    """(row_index, measure): cells below p25 / factor or above factor * p75 of their file."""
    values = cut(cell_measures(obs))
    marks = exact_quantiles(values, {"p25": (1, 4), "p75": (3, 4)}).select("grp", "measure", "p25", "p75")
    found = join_checked(values, marks, ["grp", "measure"], salt=SALT).where((F.col("value") < F.col("p25") / factor) | (F.col("value") > factor * F.col("p75")))
    return found.select("row_index", "measure")


def file_percentiles(obs: DataFrame, qs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(grp, measure, n, q, value, error) per file and measure, estimated from merged summaries."""
    return quantiles(combine(summarise(cell_measures(obs))), list(qs))
