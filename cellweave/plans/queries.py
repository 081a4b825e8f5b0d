"""Queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.index import normalize_column_indices, normalize_row_indices
from cellweave.functions.scalars import chunk_of, decode_category, local_row, quantise, scaling_factor
from cellweave.operators import align, drift, ids, matrix, obs, profile
from cellweave.operators.blocks import entries, read_blocks
from cellweave.session import join_checked


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.found(_table(spark, d, "obs"), _table(spark, d, "protocol_ref"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.checked(_table(spark, d, "obs"), _table(spark, d, "protocol_ref"))
    return profile.base_aggregates(rows)


def p2_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.checked(_table(spark, d, "obs"), _table(spark, d, "protocol_ref"))
    return profile.two_sample_test(rows)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_table(spark, d, "obs_raw"), _table(spark, d, "obs_report"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_table(_table(spark, d, "obs_raw"), _table(spark, d, "obs_report"))


_CHECKED = """WITH chk AS (SELECT o.load_no, o._row_index AS row_index, o.barcode, o._source_file,
  CASE WHEN o.barcode IS NULL THEN NULL WHEN o.scrnaseq_protocol IS NULL THEN EXISTS (SELECT 1 FROM protocol_ref q WHERE regexp_full_match(o.barcode, q.barcode_pattern))
       ELSE EXISTS (SELECT 1 FROM protocol_ref q WHERE q.scrnaseq_protocol = o.scrnaseq_protocol AND regexp_full_match(o.barcode, q.barcode_pattern)) END AS barcode_ok,
  regexp_full_match(o._source_file, '[0-9]{8}_[a-z0-9]+\\.(zarr|h5ad)') AS file_ok FROM obs o)
"""


# --- the supplier x part matrix of summed quantities stands for a count matrix -----------------


def _x(spark: SparkSession, d: str) -> DataFrame:
    """Rows are suppliers, columns parts, values summed quantities."""
    lines = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").cast("long").alias("val"))
    return matrix.sum_duplicates(lines)


def _var(spark: SparkSession, d: str) -> DataFrame:
    """Columns with names: one for each part."""
    return _table(spark, d, "part").select(F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("gene"), F.col("p_partkey").alias("col_id"))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_name", "s_nationkey", "s_acctbal")


def row_slice(spark, d):
    return matrix.select_ids(_x(spark, d), list(range(0, 10)))


def row_list(spark, d):
    return matrix.select_ids(_x(spark, d), [0, 3, 7])


def row_long_list(spark, d):
    return matrix.select_ids(_x(spark, d), list(range(1, 100_000, 3)))


def row_mask(spark, d):
    return matrix.select_ids(_x(spark, d), normalize_row_indices([i % 4 == 1 for i in range(100)], 100))


def row_packed(spark, d):
    """Packed rows, one of which does not exist and is empty."""
    wanted = [0, 1, 5, 1_000_000]
    packed = matrix.pack(matrix.select_ids(_x(spark, d), wanted), matrix.id_table(spark, wanted))
    return packed.select("row_id", F.size("cols").alias("nnz"), F.coalesce(F.array_min("cols"), F.lit(-1)).alias("first_col"), F.aggregate("vals", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def _named(spark, d, index):
    """Entries of the columns whose names are asked for: names become positions first, and those reach the scan."""
    names = [r["gene"] for r in _var(spark, d).orderBy("col_id").select("gene").collect()]  # the header of the matrix
    positions = list(normalize_column_indices(index, len(names), names))
    wanted = spark.createDataFrame([(k, names[k]) for k in positions], "col_id long, gene string")
    return join_checked(matrix.select_ids(_x(spark, d), positions, "col_id"), wanted, "col_id").select("row_id", "gene", "val")


def col_by_name(spark, d):
    return _named(spark, d, "P000042")


def col_list(spark, d):
    return matrix.select_ids(_x(spark, d), [1, 17, 42], "col_id")


def col_name_slice(spark, d):
    return _named(spark, d, slice("P000010", "P000015"))


def col_kept_cells(spark, d):
    """One column over the kept rows, with their place among them."""
    x = _x(spark, d)
    rows = obs.kept(matrix.row_stats(x), 520).select("row_id")
    placed = ids.dense_rank(rows, ["row_id"], "pos")
    return matrix.select_ids(x, [42], "col_id").join(placed, "row_id").select("pos", "row_id", "val")


def coo_dup_sum(spark, d):
    return _x(spark, d)


def coo_block_entries(spark, d):
    """Entries of stored blocks: the latest writing, repeated coordinates added."""
    return entries(read_blocks(spark, f"{d}/blockcsr.parquet"))


def row_nnz(spark, d):
    return matrix.row_stats(_x(spark, d)).select("row_id", "nnz")


def col_nnz(spark, d):
    stats = matrix.col_stats(_x(spark, d))
    return _var(spark, d).join(stats, "col_id", "left").select("gene", F.col("col_id").cast("long").alias("index"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def nnz_total(spark, d):
    return _x(spark, d).agg(F.count(F.lit(1)).alias("nnz"))


def row_qc_metrics(spark, d):
    stats = matrix.row_stats(_x(spark, d))
    return obs.with_statistics(_obs(spark, d), stats).select("row_id", "nnz", F.col("total_counts").cast("double").alias("total_counts"))


def scaling_factors(spark, d):
    stats = matrix.row_stats(_x(spark, d))
    return stats.select("row_id", F.round(scaling_factor(F.col("total_counts")).cast("double"), 5).alias("scaling_factor"))


def qc_filter_row_index(spark, d):
    """Row numbers are given before the filter, so the kept rows keep theirs."""
    stats = matrix.row_stats(_x(spark, d))
    placed = ids.dense_rank(obs.with_statistics(_obs(spark, d), stats), ["row_id"], "_row_index")
    return obs.kept(placed, 520).select("_row_index", "s_name", "nnz")


def obs_positions(spark, d):
    placed = ids.dense_rank(_obs(spark, d), ["row_id"], "pos")
    return placed.where(F.col("pos").between(5, 14)).select("pos", "row_id", "s_name")


def _target(spark, d):
    """Every third part, in falling order, as the list to align to, and a name that no source has."""
    own = _var(spark, d).where("col_id % 3 = 0")
    order = ids.dense_rank(own.select("gene", (-F.col("col_id")).alias("o")), ["o"], "new_col").select("gene", F.col("new_col").cast("int").alias("new_col"))
    return order.unionByName(own.agg(F.lit("P_NONE").alias("gene"), F.count(F.lit(1)).cast("int").alias("new_col")))


def _by_source(spark, d):
    """Three sources (by return flag) of one matrix each."""
    lines = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id"), F.col("l_quantity").cast("long").alias("val"))
    return lines.groupBy("source", "row_id", "col_id").agg(F.sum("val").alias("val"))


def align_to_gene_list(spark, d):
    x = _by_source(spark, d)
    genes = _var(spark, d).select("gene", F.col("col_id").alias("old_col")).join(x.select("source", F.col("col_id").alias("old_col")).distinct(), "old_col")
    return align.remap(x, align.gene_map(genes, _target(spark, d))).select("source", "row_id", "col_id", "val")


def missing_genes_zero(spark, d):
    x = _x(spark, d).join(_var(spark, d), "col_id")
    mapped = join_checked(x, _target(spark, d), "gene").select("row_id", F.col("new_col").alias("col_id"), "val")
    return align.with_empty_columns(matrix.col_stats(mapped), _target(spark, d))


def gene_dup_last_wins(spark, d):
    """Brands stand for genes that a source names many times: the last column counts."""
    genes = _table(spark, d, "part").select(F.lit(0).alias("source"), F.col("p_brand").alias("gene"), F.col("p_partkey").cast("int").alias("old_col"))
    target = genes.select("gene").distinct().withColumn("new_col", F.regexp_extract("gene", r"(\d+)", 1).cast("int"))
    return align.gene_map(genes, target)


def gene_overlap(spark, d):
    genes = _by_source(spark, d).select("source", F.col("col_id").cast("string").alias("gene"))
    return align.overlap(genes)


def missing_gene_names(spark, d):
    wanted = spark.range(0, 40).select(F.concat(F.lit("P"), F.lpad((F.col("id") * 1000).cast("string"), 6, "0")).alias("gene"))
    return matrix.missing(wanted, _var(spark, d).select("gene"), "gene")


def quantise_clamp(spark, d):
    prices = _table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    return prices.select("row_id", "col_id", quantise(F.col("price")).alias("val"))


def _obs_frames(spark, d):
    a = _table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("_source_file"))
    b = _table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("_source_file"))
    return [a, b]


def obs_outer(spark, d):
    return obs.concat_obs(_obs_frames(spark, d), "outer")


def obs_inner(spark, d):
    return obs.concat_obs(_obs_frames(spark, d), "inner")


def obs_columns(spark, d):
    return obs.concat_obs(_obs_frames(spark, d), "columns", ["name"])


def obs_column_report(spark, d):
    rows = [(n, c) for n in ("region", "nation", "supplier", "customer") for c in sorted({x.split("_", 1)[1] for x in _table(spark, d, n).columns})]
    return obs.column_report_table(spark.createDataFrame(rows, "dataset string, column string"))


def multi_source_row_ids(spark, d):
    """Dense row numbers over three sources: the order of sources first, then the row in each."""
    x = _by_source(spark, d).select(F.col("source"), "row_id").distinct()
    local = x.withColumn("local_row", F.col("row_id"))
    size = _table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n_rows"))
    counts = x.select("source").distinct().join(F.broadcast(size), F.lit(True))
    return ids.global_rows(local, ids.source_offsets(counts, "source"), "local_row", "source", "global_row").select("source", "row_id", "global_row")


def transpose_cm(spark, d):
    return matrix.transpose(_x(spark, d))


def row_packed_arrays(spark, d):
    x = _x(spark, d)
    return matrix.unpack(matrix.pack(x, x.select("row_id").distinct()))


def vstack_rows(spark, d):
    n = _table(spark, d, "supplier").count()
    x = _x(spark, d)
    return matrix.vstack([(x, n), (x, n)])


def hstack_columns(spark, d):
    n = _table(spark, d, "part").count()
    x = _x(spark, d)
    return matrix.hstack([(x, n), (x, n)]).select("row_id", F.col("col_id").cast("long").alias("col_id"), "val")


def in_shape_entries(spark, d):
    """Within the shape of the tables less one: the greatest numbers lie outside."""
    return matrix.in_shape(_x(spark, d), _table(spark, d, "supplier").count() - 1, _table(spark, d, "part").count() - 1)


def chunk_stats(spark, d):
    return matrix.chunk_stats(_x(spark, d), 8)


def chunk_coordinates(spark, d):
    return _obs(spark, d).select("row_id", chunk_of(F.col("row_id"), 16).alias("chunk"), local_row(F.col("row_id"), 16).alias("local_row"))


def category_decode(spark, d):
    """Codes into a list of categories; some lie outside and give null."""
    cats = F.array(F.lit("low"), F.lit("mid"), F.lit("high"))
    return _table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), decode_category((F.col("s_nationkey") % 6 - 1).cast("int"), cats).alias("category"))


def _estimate(spark, nnz: DataFrame, k: int):
    """The estimate for the entries summed up in ``nnz`` (one row)."""
    got = matrix.memory_estimate(int(nnz.collect()[0][0]), k)
    return spark.createDataFrame([(got["nnz"], got["bytes"])], "nnz long, bytes long")


def memory_estimate_rows(spark, d):
    return _estimate(spark, matrix.select_ids(matrix.row_stats(_x(spark, d)), list(range(0, 10))).agg(F.sum("nnz")), 10)


def memory_estimate_cols(spark, d):
    return _estimate(spark, matrix.select_ids(matrix.col_stats(_x(spark, d)), [1, 17, 42], "col_id").agg(F.sum("nnz")), 3)


def memory_estimate_all(spark, d):
    return _estimate(spark, _x(spark, d).agg(F.count(F.lit(1))), _table(spark, d, "supplier").count())


def random_rows_count(spark, d):
    n = _table(spark, d, "supplier").count()
    chosen = sorted(matrix.random_rows(5, n, seed=7))
    return matrix.row_stats(matrix.select_ids(_x(spark, d), chosen)).select("row_id", "nnz")


def event_matrix_stats(spark, d):
    """A matrix with very few columns: users by event type."""
    events = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("val"))
    return events.groupBy(F.col("event_type").alias("gene")).agg(F.count(F.lit(1)).alias("nnz"), F.sum("val").alias("total"))


def dense_rows(spark, d):
    """Packed dense rows as entries."""
    packed = _table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("col_id", "val"))
    return matrix.col_stats(packed)


_CORE = (
    row_slice, row_list, row_long_list, row_mask, row_packed, row_packed_arrays, col_by_name, col_list, col_name_slice, col_kept_cells, coo_dup_sum, coo_block_entries, transpose_cm,
    row_nnz, col_nnz, nnz_total, row_qc_metrics, scaling_factors, qc_filter_row_index, obs_positions, align_to_gene_list, missing_genes_zero, gene_dup_last_wins, gene_overlap,
    missing_gene_names, quantise_clamp, obs_outer, obs_inner, obs_columns, obs_column_report, multi_source_row_ids, vstack_rows, hstack_columns, in_shape_entries, chunk_stats,
    chunk_coordinates, category_decode, memory_estimate_rows, memory_estimate_cols, memory_estimate_all, random_rows_count, event_matrix_stats, dense_rows,
)

_X = "x AS (SELECT l_suppkey AS row_id, l_partkey AS col_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2)"
_VAR = "v AS (SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS gene, p_partkey AS col_id FROM part)"
_S = "s AS (SELECT l_returnflag AS source, l_suppkey AS row_id, l_partkey AS col_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2, 3)"
_ROWS = "r AS (SELECT row_id, count(*) AS nnz, CAST(sum(val) AS DOUBLE) AS total FROM x GROUP BY 1)"
_TARGET = "own AS (SELECT gene, col_id FROM v WHERE col_id % 3 = 0), t AS (SELECT gene, CAST(row_number() OVER (ORDER BY col_id DESC) - 1 AS INTEGER) AS new_col FROM own UNION ALL SELECT 'P_NONE', CAST(count(*) AS INTEGER) FROM own)"
_OA = "a AS (SELECT s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, s_acctbal AS balance, 'supplier' AS _source_file FROM supplier), b AS (SELECT c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, 'customer' AS _source_file FROM customer)"

_CORE_SQL = {
    "row_slice": f"WITH {_X} SELECT * FROM x WHERE row_id BETWEEN 0 AND 9",
    "row_list": f"WITH {_X} SELECT * FROM x WHERE row_id IN (0, 3, 7)",
    "row_long_list": f"WITH {_X} SELECT * FROM x WHERE row_id % 3 = 1 AND row_id < 100000",
    "row_mask": f"WITH {_X} SELECT * FROM x WHERE row_id < 100 AND row_id % 4 = 1",
    "row_packed": f"WITH {_X}, w(row_id) AS (VALUES (0), (1), (5), (1000000)) SELECT CAST(w.row_id AS BIGINT) AS row_id, CAST(count(col_id) AS INTEGER) AS nnz, coalesce(min(col_id), -1) AS first_col, CAST(coalesce(sum(val), 0) AS BIGINT) AS total FROM w LEFT JOIN x ON x.row_id = w.row_id GROUP BY 1",
    "col_by_name": f"WITH {_X}, {_VAR} SELECT row_id, gene, val FROM x JOIN v USING (col_id) WHERE gene = 'P000042'",
    "col_list": f"WITH {_X} SELECT * FROM x WHERE col_id IN (1, 17, 42)",
    "col_name_slice": f"WITH {_X}, {_VAR} SELECT row_id, gene, val FROM x JOIN v USING (col_id) WHERE gene BETWEEN 'P000010' AND 'P000015'",
    "col_kept_cells": f"WITH {_X}, {_ROWS}, k AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM r WHERE nnz >= 520) SELECT pos, row_id, val FROM x JOIN k USING (row_id) WHERE col_id = 42",
    "coo_dup_sum": f"WITH {_X} SELECT * FROM x",
    "coo_block_entries": """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_row ORDER BY written_at DESC) AS rn FROM blockcsr) WHERE rn = 1),
rws AS (SELECT start_row + i AS row_id, ncols, indices[indptr[i+1]+1 : indptr[i+2]] AS c, data[indptr[i+1]+1 : indptr[i+2]] AS v FROM (SELECT *, unnest(range(nrows_in_block)) AS i FROM latest)),
raw AS (SELECT row_id, ncols, unnest(c) AS col_id, unnest(v) AS val FROM rws)
SELECT row_id, col_id, CAST(sum(val) AS BIGINT) AS val FROM raw WHERE col_id >= 0 AND col_id < ncols GROUP BY 1, 2""",
    "row_nnz": f"WITH {_X} SELECT row_id, count(*) AS nnz FROM x GROUP BY 1",
    "col_nnz": f"WITH {_X}, {_VAR}, c AS (SELECT col_id, count(*) AS nnz FROM x GROUP BY 1) SELECT gene, CAST(col_id AS BIGINT) AS index, coalesce(nnz, 0) AS nnz FROM v LEFT JOIN c USING (col_id)",
    "nnz_total": f"WITH {_X} SELECT count(*) AS nnz FROM x",
    "row_qc_metrics": f"WITH {_X}, {_ROWS} SELECT s_suppkey AS row_id, coalesce(nnz, 0) AS nnz, coalesce(total, 0) AS total_counts FROM supplier LEFT JOIN r ON r.row_id = s_suppkey",
    "scaling_factors": f"WITH {_X}, {_ROWS} SELECT row_id, round(CAST(CAST(10000.0 AS DOUBLE) / total AS FLOAT)::DOUBLE, 5) AS scaling_factor FROM r",
    "qc_filter_row_index": f"WITH {_X}, {_ROWS}, o AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _row_index, s_name, s_suppkey FROM supplier) SELECT _row_index, s_name, nnz FROM o JOIN r ON r.row_id = s_suppkey WHERE nnz >= 520",
    "obs_positions": "SELECT * FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey AS row_id, s_name FROM supplier) WHERE pos BETWEEN 5 AND 14",
    "align_to_gene_list": f"WITH {_S}, {_VAR}, {_TARGET} SELECT source, row_id, new_col AS col_id, val FROM s JOIN v USING (col_id) JOIN t USING (gene)",
    "missing_genes_zero": f"WITH {_X}, {_VAR}, {_TARGET} SELECT t.gene, CAST(new_col AS BIGINT) AS index, count(x.row_id) AS nnz FROM t LEFT JOIN v ON v.gene = t.gene LEFT JOIN x ON x.col_id = v.col_id GROUP BY 1, 2",
    "gene_dup_last_wins": "SELECT 0 AS source, CAST(max(p_partkey) AS INTEGER) AS old_col, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS new_col FROM part GROUP BY p_brand",
    "gene_overlap": f"WITH {_S}, g AS (SELECT DISTINCT source, col_id FROM s), f AS (SELECT col_id, min(source) AS first, count(*) AS k FROM g GROUP BY 1) SELECT source, count(*) AS n_genes, count(*) FILTER (WHERE first < source) AS seen_before, count(*) FILTER (WHERE k = (SELECT count(DISTINCT source) FROM g)) AS in_all FROM g JOIN f USING (col_id) GROUP BY 1",
    "missing_gene_names": f"WITH {_VAR}, w AS (SELECT 'P' || lpad(CAST(i * 1000 AS VARCHAR), 6, '0') AS gene FROM range(40) t(i)) SELECT gene FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.gene = w.gene)",
    "quantise_clamp": "SELECT l_suppkey AS row_id, l_partkey AS col_id, CAST(floor(least(greatest(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 0), 65535) + 0.5) AS INTEGER) AS val FROM lineitem GROUP BY 1, 2",
    "obs_outer": f"WITH {_OA} SELECT * FROM a UNION ALL BY NAME SELECT * FROM b",
    "obs_inner": f"WITH {_OA} SELECT name, nation, _source_file FROM a UNION ALL SELECT name, nation, _source_file FROM b",
    "obs_columns": f"WITH {_OA} SELECT name, _source_file FROM a UNION ALL SELECT name, _source_file FROM b",
    "obs_column_report": """WITH l AS (SELECT DISTINCT table_name AS dataset, regexp_replace(column_name, '^[a-z]+_', '') AS c FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier', 'customer')),
k AS (SELECT c, count(*) = 4 AS common FROM l GROUP BY 1)
SELECT dataset, coalesce(string_agg(c, ', ' ORDER BY c) FILTER (WHERE common), '') AS common_columns, coalesce(string_agg(c, ', ' ORDER BY c) FILTER (WHERE NOT common), '') AS unique_columns FROM l JOIN k USING (c) GROUP BY 1""",
    "multi_source_row_ids": f"WITH {_S}, d AS (SELECT DISTINCT source, row_id FROM s), o AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) * (SELECT count(*) FROM supplier) AS off FROM (SELECT DISTINCT source FROM s)) SELECT source, row_id, CAST(off + row_id AS BIGINT) AS global_row FROM d JOIN o USING (source)",
    "chunk_stats": f'WITH {_X} SELECT CAST(row_id // 8 AS INTEGER) AS chunk, min(row_id) AS start, max(row_id) AS "end", count(*) AS nnz FROM x GROUP BY 1',
    "chunk_coordinates": "SELECT s_suppkey AS row_id, CAST(s_suppkey // 16 AS INTEGER) AS chunk, s_suppkey % 16 AS local_row FROM supplier",
    "category_decode": "SELECT s_suppkey AS row_id, CASE s_nationkey % 6 - 1 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' END AS category FROM supplier",
    "memory_estimate_rows": f"WITH {_X} SELECT count(*) AS nnz, count(*) * 12 + 44 AS bytes FROM x WHERE row_id < 10",
    "memory_estimate_cols": f"WITH {_X} SELECT count(*) AS nnz, count(*) * 12 + 16 AS bytes FROM x WHERE col_id IN (1, 17, 42)",
    "memory_estimate_all": f"WITH {_X} SELECT count(*) AS nnz, count(*) * 12 + ((SELECT count(*) FROM supplier) + 1) * 4 AS bytes FROM x",
    "event_matrix_stats": "SELECT event_type AS gene, count(*) AS nnz, CAST(sum(val) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS val FROM events GROUP BY 1, 2) GROUP BY 1",
    "transpose_cm": f"WITH {_X} SELECT col_id AS row_id, row_id AS col_id, val FROM x",
    "row_packed_arrays": f"WITH {_X} SELECT * FROM x",
    "vstack_rows": f"WITH {_X} SELECT row_id, col_id, val FROM x UNION ALL SELECT row_id + (SELECT count(*) FROM supplier), col_id, val FROM x",
    "hstack_columns": f"WITH {_X} SELECT row_id, col_id, val FROM x UNION ALL SELECT row_id, col_id + (SELECT count(*) FROM part), val FROM x",
    "in_shape_entries": f"WITH {_X} SELECT * FROM x WHERE row_id < (SELECT count(*) - 1 FROM supplier) AND col_id < (SELECT count(*) - 1 FROM part)",
    "dense_rows": "SELECT CAST(i AS INTEGER) AS col_id, count(*) AS nnz FROM (SELECT unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1",
}

QUERIES: dict = {f.__name__: f for f in (*_CORE, p2_found, p2_profile, p2_drift, p6_found, p6_table)}
SQL: dict = {
    **_CORE_SQL,
    "p2_found": _CHECKED
    + """, n AS (SELECT load_no, count(*) AS n, count(*) FILTER (WHERE barcode IS NULL) / count(*) AS nb, count(*) FILTER (WHERE _source_file IS NULL) / count(*) AS nf FROM chk GROUP BY 1),
t AS (SELECT load_no, max(k) AS k FROM (SELECT load_no, _source_file, count(*) AS k FROM chk WHERE _source_file IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT load_no, nb, nf, coalesce(k, 0) / n AS ts, lag(nb) OVER w AS nb0, lag(nf) OVER w AS nf0, lag(coalesce(k, 0) / n) OVER w AS ts0 FROM n LEFT JOIN t USING (load_no) WHERE load_no IS NOT NULL WINDOW w AS (ORDER BY load_no))
SELECT load_no, 'barcode' AS column_name, 'pattern' AS measure, row_index FROM chk WHERE NOT barcode_ok
UNION ALL SELECT load_no, '_source_file', 'pattern', row_index FROM chk WHERE NOT file_ok
UNION ALL SELECT load_no, 'barcode', 'null_share', CAST(-1 AS BIGINT) FROM s WHERE abs(nb - nb0) > 0.05
UNION ALL SELECT load_no, '_source_file', 'null_share', CAST(-1 AS BIGINT) FROM s WHERE abs(nf - nf0) > 0.05
UNION ALL SELECT load_no, '_source_file', 'top_share', CAST(-1 AS BIGINT) FROM s WHERE abs(ts - ts0) > 0.15""",
    "p2_profile": _CHECKED
    + """, v AS (SELECT load_no, 'barcode' AS column_name, barcode AS v, barcode_ok AS ok FROM chk UNION ALL SELECT load_no, '_source_file', _source_file, file_ok FROM chk),
k AS (SELECT load_no, column_name, v, count(*) AS k FROM v WHERE v IS NOT NULL GROUP BY 1, 2, 3),
kk AS (SELECT load_no, column_name, max(k) AS top_rows, count(*) AS n_distinct FROM k GROUP BY 1, 2)
SELECT b.*, coalesce(kk.top_rows, 0) AS top_rows, coalesce(kk.n_distinct, 0) AS n_distinct FROM (SELECT column_name, load_no, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE NOT ok) AS malformed, min(v) AS least, max(v) AS greatest FROM v GROUP BY 1, 2) b
LEFT JOIN kk ON kk.column_name = b.column_name AND kk.load_no IS NOT DISTINCT FROM b.load_no""",
}
