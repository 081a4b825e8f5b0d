"""Frequency of every distinct term, by heavy-light aggregation.

Heavy terms are found on a bounded sample and broadcast (at most ``HEAVY``); every task
counts them exactly in local arrays and gives one row per heavy term. All other terms are
pre-aggregated per batch, shuffled and added up. Both tables are united. Which terms are
taken as heavy has no effect on any count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.blocks import decode, latest_blocks, slices, sum_cells
from cellweave.session import bounded, cut

#: Most terms that are counted in local arrays.
HEAVY = 512
#: Blocks looked at to find heavy terms (a hint only).
DETECT_BLOCKS = 256
#: Most gene columns whose names are handed to every task; beyond, names are joined to the entries.
MOST_COLUMNS = 2_000_000
_OUT = "term string, entries long, records long"


def clean_name(column) -> F.Column:
    """Name without surrounding white space of any kind, upper-cased; blank is missing."""
    name = F.upper(F.regexp_replace(column, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)


def detect_heavy(terms: DataFrame, most: int = HEAVY) -> list:
    """The most frequent of the ``term`` values given, at most ``most``."""
    return [r[0] for r in terms.where("term is not null").groupBy("term").count().orderBy(F.desc("count"), "term").limit(most).select("term").collect()]


def _unite(parts: DataFrame) -> DataFrame:
    """Add up heavy partials (a bounded number per task) and light partials apart, then unite."""
    add = [F.sum("entries").cast("long").alias("entries"), F.sum("records").cast("long").alias("records")]
    return parts.groupBy("heavy", "term").agg(*add).select("term", "entries", "records")


def term_frequencies(df: DataFrame, terms: str, heavy: list | None = None) -> DataFrame:
    """(term, entries, records) over an array column ``terms`` of one record per row.

    Null arrays and null elements count nothing; a term repeated in a record adds to
    ``entries`` each time and to ``records`` once. No rows give no rows. Other columns do
    not matter.
    """
    df = df.select(F.col(terms).cast("array<string>").alias("terms"))
    if heavy is None:
        heavy = detect_heavy(df.limit(DETECT_BLOCKS * 16).select(F.explode("terms").alias("term")))
    heavy = list(heavy)[:HEAVY]

    def run(batches):
        slot = {t: i for i, t in enumerate(heavy)}
        count = np.zeros((2, len(heavy)), np.int64)
        for batch in batches:
            column = batch.column(0)
            lists = column.fill_null([]) if column.null_count else column
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            record = np.repeat(np.arange(len(size)), size)
            code = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            record, code = record[code >= 0], code[code >= 0]
            names = words.dictionary.to_pylist()
            n = np.bincount(code, minlength=len(names))
            pairs = np.unique(record * max(len(names), 1) + code)
            m = np.bincount(pairs % max(len(names), 1), minlength=len(names)) if len(pairs) else np.zeros(len(names), np.int64)
            light = []
            for k, name in enumerate(names):
                at = slot.get(name)
                if at is None:
                    light.append(k)
                else:
                    count[0, at] += n[k]
                    count[1, at] += m[k]
            yield _batch([False] * len(light), [names[k] for k in light], n[light], m[light])
        seen = np.flatnonzero(count[0])
        yield _batch([True] * len(seen), [heavy[k] for k in seen], count[0][seen], count[1][seen])

    return _unite(df.mapInArrow(run, "heavy boolean, " + _OUT))


def _batch(heavy, term, entries, records) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(heavy, pa.bool_()), pa.array(term, pa.string()), pa.array(entries, pa.int64()), pa.array(records, pa.int64())], ["heavy", "term", "entries", "records"])


def gene_frequencies(blocks: DataFrame, genes: DataFrame, rare: float = 0.005, common: float = 0.5) -> DataFrame:
    """(gene, entries, cells, all_cells, share, mark) of every gene name of ``genes``.

    Names are trimmed and upper-cased; missing or blank names are left out and all columns of
    a name are taken together. ``entries`` are the stored entries; a cell has a gene if its
    summed data over the name's columns is above 0. Genes without entries are given with 0.
    ``mark`` is 'rare', 'common' or ''. Without any cell the share is null and nothing is marked.
    """
    named = genes.select(clean_name(F.col("gene")).alias("gene"), F.col("index").cast("long").alias("index")).where("gene is not null and index is not null").distinct()
    if not bounded(named, MOST_COLUMNS):
        return _marked(named.select("gene").distinct(), _joined_counts(blocks, named), latest_blocks(blocks).agg(F.coalesce(F.sum("nrows_in_block"), F.lit(0)).alias("all_cells")), rare, common)
    table = named.toArrow()  # the header of the matrix
    names = pa.concat_arrays(table.column("gene").chunks).unique() if table.num_rows else pa.array([], pa.string())
    number = {g: i for i, g in enumerate(names.to_pylist())}
    columns = [(int(c), number[g]) for g, c in zip(table.column("gene").to_pylist(), table.column("index").to_pylist())]
    width = max([c for c, _ in columns if c >= 0], default=-1) + 1
    place = np.full(width, -1, np.int64)  # column -> name; a column has one name, as index is unique
    for c, k in columns:
        if c >= 0:
            place[c] = k
    current = latest_blocks(blocks)
    few = blocks.select("indices").limit(DETECT_BLOCKS).select(F.explode("indices").alias("c")).groupBy("c").count()
    seen: dict[int, int] = {}
    for r in few.orderBy(F.desc("count")).limit(4 * HEAVY).collect():
        if r["c"] is not None and 0 <= r["c"] < width and place[r["c"]] >= 0:
            seen[int(place[r["c"]])] = seen.get(int(place[r["c"]]), 0) + r["count"]
    heavy = np.array(sorted(sorted(seen, key=lambda k: (-seen[k], k))[:HEAVY]), np.int64)
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((place, heavy, len(names)))

    def run(batches):
        place, heavy, n_names = shared.value
        is_heavy = np.zeros(n_names + 1, bool)
        is_heavy[heavy] = True
        local = np.zeros((2, n_names + 1), np.int64)  # only heavy slots are kept over batches
        total = 0
        for batch in slices(batches):
            cells, row, col, data = decode(batch)
            total += len(cells)
            inside = col < len(place)
            name = np.full(len(col), -1, np.int64)
            name[inside] = place[col[inside]]
            good = name >= 0
            row, name, data = row[good], name[good], data[good]
            n = np.bincount(name, minlength=n_names + 1)
            _, who, amount = sum_cells(row, name, data)
            m = np.bincount(who[amount > 0], minlength=n_names + 1)
            local[0, is_heavy] += n[is_heavy]
            local[1, is_heavy] += m[is_heavy]
            n[is_heavy] = 0
            at = np.flatnonzero(n)
            yield out(np.zeros(len(at), bool), at, n[at], m[at])
        at = np.flatnonzero(local[0])
        yield out(np.ones(len(at), bool), at, local[0][at], local[1][at])
        yield out(np.ones(1, bool), np.array([-1]), np.array([total]), np.array([total]))

    def out(heavy, name, n, m):
        return pa.RecordBatch.from_arrays([pa.array(heavy), pa.array(name, pa.int32()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["heavy", "term", "entries", "records"])

    counts = cut(_unite(current.mapInArrow(run, "heavy boolean, term int, entries long, records long")))
    numbered = spark.createDataFrame(pa.table({"term": pa.array(range(len(names)), pa.int32()), "gene": names}))
    total = counts.where("term = -1").agg(F.coalesce(F.max("entries"), F.lit(0)).alias("all_cells"))
    return _marked(numbered.select("gene"), numbered.join(counts, "term").select("gene", "entries", "records"), total, rare, common)


def _joined_counts(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """(gene, entries, records) where the header is too wide to hand to every task: names are joined to the entries."""

    def run(batches):
        for batch in slices(batches):
            _, row, col, data = decode(batch)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(data, pa.int64())], ["row_id", "index", "val"])

    flat = latest_blocks(blocks).mapInArrow(run, "row_id long, index long, val long").join(named, "index")
    per_cell = flat.groupBy("gene", "row_id").agg(F.sum("val").alias("val"), F.count(F.lit(1)).alias("n"))
    return per_cell.groupBy("gene").agg(F.sum("n").alias("entries"), F.count_if(F.col("val") > 0).alias("records"))


def _marked(names: DataFrame, counts: DataFrame, total: DataFrame, rare: float, common: float) -> DataFrame:
    """Every name with its counts, 0 where it has none, and its mark; ``total`` has one row."""
    rows = names.join(counts, "gene", "left").join(F.broadcast(total), F.lit(True))
    cells, every = F.coalesce("records", F.lit(0)), F.col("all_cells")
    mark = F.when(every == 0, "").when(cells < F.lit(rare) * every, "rare").when(cells > F.lit(common) * every, "common").otherwise("")
    share = F.when(every > 0, cells / every)
    return rows.select("gene", F.coalesce("entries", F.lit(0)).alias("entries"), cells.alias("cells"), every.cast("long").alias("all_cells"), share.alias("share"), mark.alias("mark"))
