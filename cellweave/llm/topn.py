"""Top N items of every group, by merging sorted runs with a loser tree.

Rows are put into runs, sorted by group, score descending and item. A run keeps at most N rows of
a group, which is all that it can add to the result, so a group of any size sends N
rows per run. Runs are brought together in buckets of groups, where Spark sorts them; each bucket merges its
runs with a loser tree and, after N outputs of a group, every run seeks to the next group.

The runs of a table are its tasks; those of a matrix are stripes of its columns within each task, so a
cell's genes stand in as many runs as there are stripes and its N highest are found by merging.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.blocks import decode, latest_blocks, slices, sum_cells

#: Stripes of columns, each of them a run.
STRIPES = 4
#: Groups of a bucket, about; bounds what a merge holds.
GROUPS = 16_384
_RUN = "bucket int, run long, grp long, score double, item long"
_OUT = "grp long, rank_no int, item long, score double"


class LoserTree:
    """Tournament over run heads; ``winner`` is the run with the smallest key, exhausted runs lose.

    ``node[k]`` keeps the loser of match k, so replacing the winner's head costs one path.
    """

    END = (2**63,)

    def __init__(self, heads: list[tuple]):
        self.k = max(1, len(heads))
        self.keys = list(heads) or [self.END]
        self.node = [-1] * self.k
        self.winner = 0
        for run in range(self.k):
            self._play(run, first=True)

    def _play(self, run: int, first: bool = False) -> None:
        at = (run + self.k) // 2
        keys, node = self.keys, self.node
        while at > 0:
            other = node[at]
            if other < 0:
                if first:
                    node[at] = run
                    return
            elif keys[other] < keys[run] or (keys[other] == keys[run] and other < run):
                node[at], run = run, other
            at //= 2
        self.winner = run

    def replace(self, key: tuple) -> None:
        self.keys[self.winner] = key
        self._play(self.winner)


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
    """Yield (group, rank, item, score) of the N first of every group over runs of (group, score, item).

    Each run is ordered by group, score descending, item. An item that stands in several runs
    with the same score counts once.
    """
    runs = [r for r in runs if len(r[0])]
    if not runs:
        return
    data = [(g.tolist(), s.tolist(), i.tolist()) for g, s, i in runs]
    ends = [np.concatenate((np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)])) for g, _, _ in runs]
    place, segment = [0] * len(runs), [0] * len(runs)

    def head(r: int) -> tuple:
        p = place[r]
        g, s, i = data[r]
        return (g[p], -s[p], i[p]) if p < len(g) else LoserTree.END

    tree = LoserTree([head(r) for r in range(len(runs))])
    group, rank, last = None, 0, None
    while True:
        r = tree.winner
        key = tree.keys[r]
        if key is LoserTree.END:
            return
        if key[0] != group:
            group, rank, last = key[0], 0, None
        if rank >= n:  # seek: jump over what this run still has of the group
            while ends[r][segment[r]] <= place[r]:
                segment[r] += 1
            place[r] = int(ends[r][segment[r]])
        else:
            if key != last:
                rank += 1
                last = key
                yield group, rank, key[2], -key[1]
            place[r] += 1
        tree.replace(head(r))


def _merged(n: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The N first of every group of one bucket, whose rows come ordered by run, group, score descending and item."""
    table = pa.Table.from_batches(parts)
    run, grp, score, item = (table.column(c).to_numpy() for c in ("run", "grp", "score", "item"))
    cuts = np.flatnonzero(run[1:] != run[:-1]) + 1
    got: list[list] = [[], [], [], []]
    for row in merge_runs(list(zip(np.split(grp, cuts), np.split(score, cuts), np.split(item, cuts))), n):
        for k, v in enumerate(row):
            got[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.int64()), pa.array(got[3], pa.float64())], ["grp", "rank_no", "item", "score"])


def _merge_buckets(n: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if held and bucket[lo] != now:  # one bucket at a time is in memory
                    yield _merged(n, held)
                    held = []
                now = bucket[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield _merged(n, held)

    return run


def _merge(runs: DataFrame, n: int) -> DataFrame:
    """Bring the runs of each bucket together, sorted by Spark, which spills where it has to, and merge them."""
    return runs.repartition("bucket").sortWithinPartitions("bucket", "run", "grp", F.desc("score"), "item").mapInArrow(_merge_buckets(n), _OUT)


def _cut_run(n: int, buckets: int):
    """Of a sorted stream (group, score, item) keep N rows per group; the task's rows are one run."""

    def run(batches):
        me = TaskContext.get().partitionId()
        last, had = None, 0
        for batch in batches:
            grp = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(grp):
                continue
            start = np.concatenate(([0], np.flatnonzero(grp[1:] != grp[:-1]) + 1))
            rank = np.arange(len(grp)) - np.repeat(start, np.diff(np.concatenate((start, [len(grp)]))))
            if grp[0] == last:
                first = len(grp) if len(start) == 1 else start[1]
                rank[:first] += had
            last, had = grp[-1], int(rank[-1]) + 1
            keep = np.flatnonzero(rank < n)
            yield _rows(buckets, me, grp[keep], batch.column(1).to_numpy(zero_copy_only=False)[keep], batch.column(2).to_numpy(zero_copy_only=False)[keep])

    return run


def _rows(buckets: int, run, grp, score, item) -> pa.RecordBatch:
    mixed = (grp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return pa.RecordBatch.from_arrays(
        [pa.array((mixed % np.uint64(buckets)).astype(np.int32)), pa.array(np.broadcast_to(np.asarray(run, np.int64), len(grp))), pa.array(grp, pa.int64()), pa.array(score, pa.float64()), pa.array(item, pa.int64())],
        ["bucket", "run", "grp", "score", "item"],
    )


def _buckets(df: DataFrame, groups: int) -> int:
    """Buckets of about ``GROUPS`` groups, at least one for each shuffle partition."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS))


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """(grp, rank_no, item, score): the ``n`` highest scores of every group, ties by smaller item.

    Group and item are integers. Rows with null group, item or score, or a NaN score, are left
    out; equal rows count once; ``n`` <= 0 and empty input give no rows. Other columns are not read.
    """
    flat = df.select(F.col(group).cast("long").alias("grp"), F.col(score).cast("double").alias("score"), F.col(item).cast("long").alias("item"))
    flat = flat.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    # equal rows within a task would fill a run's N places, so they are merged before the cut
    buckets = _buckets(df, flat.agg(F.approx_count_distinct("grp", 0.1)).collect()[0][0])
    return _merge(flat.sortWithinPartitions("grp", F.desc("score"), "item").mapInArrow(_without_repeats, flat.schema).mapInArrow(_cut_run(max(n, 0), buckets), _RUN), n)


def _without_repeats(batches):
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, s, i = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])))
        new[0] = (g[0], s[0], i[0]) != last
        last = (g[-1], s[-1], i[-1])
        yield batch.filter(pa.array(new))


def top_genes(blocks: DataFrame, n: int = 3, stripes: int = STRIPES) -> DataFrame:
    """(row_index, rank_no, gene_index, value): the ``n`` highest genes of every cell.

    Only the latest writing of a block counts, values at one coordinate add up, sums above 0
    qualify, ties go to the smaller gene. Cells without such entries have no rows.
    """
    current = latest_blocks(blocks)
    buckets = _buckets(blocks, int(current.agg(F.sum("nrows_in_block")).collect()[0][0] or 0))

    def run(batches):
        me = TaskContext.get().partitionId() * stripes
        for batch in slices(batches):
            row, col, data = sum_cells(*decode(batch)[1:])
            good = data > 0
            row, col, data = row[good], col[good], data[good]
            stripe = col % stripes
            order = np.lexsort((col, -data, row, stripe))
            row, col, data, stripe = row[order], col[order], data[order], stripe[order]
            if not len(row):
                continue
            start = np.concatenate(([0], np.flatnonzero((row[1:] != row[:-1]) | (stripe[1:] != stripe[:-1])) + 1))
            rank = np.arange(len(row)) - np.repeat(start, np.diff(np.concatenate((start, [len(row)]))))
            keep = rank < n
            yield _rows(buckets, me + stripe[keep], row[keep], data[keep], col[keep])

    return _merge(current.mapInArrow(run, _RUN), n).select(F.col("grp").alias("row_index"), "rank_no", F.col("item").cast("int").alias("gene_index"), F.col("score").cast("long").alias("value"))
