"""SQL equivalents of the queries that SQL can express."""

#: Every valid entry of the latest writing of each block, repeated coordinates added up.
_CELLS = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start_row ORDER BY written_at DESC) AS rn FROM blockcsr) WHERE rn = 1),
rws AS (SELECT start_row + i AS row_index, ncols, indices[indptr[i+1]+1 : indptr[i+2]] AS c, data[indptr[i+1]+1 : indptr[i+2]] AS v
        FROM (SELECT *, unnest(range(nrows_in_block)) AS i FROM latest)),
raw AS (SELECT row_index, ncols, unnest(c) AS col, unnest(v) AS val FROM rws),
x AS (SELECT row_index, col, sum(val) AS val, count(*) AS n FROM raw WHERE col >= 0 AND col < ncols GROUP BY 1, 2)
"""

_GENES = f"""WITH {_CELLS},
g AS (SELECT DISTINCT upper(regexp_replace(gene, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS gene, "index" AS col FROM var_genes),
named AS (SELECT * FROM g WHERE gene IS NOT NULL AND gene <> ''),
per_cell AS (SELECT gene, row_index, sum(val) AS val, sum(n) AS n FROM x JOIN named USING (col) GROUP BY 1, 2),
per_gene AS (SELECT gene, sum(n) AS entries, count(*) FILTER (WHERE val > 0) AS cells FROM per_cell GROUP BY 1),
total AS (SELECT CAST(coalesce(sum(nrows_in_block), 0) AS BIGINT) AS all_cells FROM latest),
counted AS (SELECT gene, CAST(coalesce(entries, 0) AS BIGINT) AS entries, CAST(coalesce(cells, 0) AS BIGINT) AS cells, all_cells
            FROM (SELECT DISTINCT gene FROM named) LEFT JOIN per_gene USING (gene), total),
marked AS (SELECT *, CASE WHEN cells < 0.005 * all_cells THEN 'rare' WHEN cells > 0.5 * all_cells THEN 'common' ELSE '' END AS mark FROM counted)
"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_CELLS},
v AS (SELECT row_index, col, val / sqrt(sum(CAST(val AS DOUBLE) * val) OVER (PARTITION BY row_index)) AS w FROM x WHERE val <> 0),
near AS (SELECT a.row_index AS i, b.row_index AS j FROM v a JOIN v b ON a.col = b.col AND a.row_index <> b.row_index GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.75),
reach AS (SELECT i, j FROM near UNION SELECT r.i, n.j FROM reach r JOIN near n ON r.j = n.i)
SELECT min(j) AS cluster_id, i AS row_index FROM reach GROUP BY i""",
    "p3_counts": _GENES + "SELECT gene, entries, cells, all_cells, mark FROM marked",
    "p3_found": _GENES + "SELECT gene, mark FROM marked WHERE mark <> ''",
    "p3_terms": """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents)
SELECT term, count(*) AS entries, count(DISTINCT doc_id) AS records FROM w WHERE term <> '' GROUP BY 1""",
    "p4_found": f"""WITH {_CELLS}
SELECT row_index, CAST(rank_no AS INTEGER) AS rank_no, CAST(col AS INTEGER) AS gene_index
FROM (SELECT row_index, col, row_number() OVER (PARTITION BY row_index ORDER BY val DESC, col) AS rank_no FROM x WHERE val > 0)
WHERE rank_no <= 3""",
    "p5_found": """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _row_index ORDER BY load_no DESC) AS rn FROM obs WHERE _row_index IS NOT NULL)
  WHERE rn = 1 AND regexp_full_match(_source_file, '[0-9]{8}_[a-z0-9]+\\.(zarr|h5ad)')),
v AS (SELECT _row_index AS row_index, _source_file AS f, 'nnz' AS measure, CAST(nnz AS DOUBLE) AS v FROM cur UNION ALL SELECT _row_index, _source_file, 'total_counts', CAST(total_counts AS DOUBLE) FROM cur),
g AS (SELECT *, row_number() OVER (PARTITION BY f, measure ORDER BY v) AS r, count(*) OVER (PARTITION BY f, measure) AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0),
q AS (SELECT f, measure, max(v) FILTER (WHERE r = (n + 3) // 4) AS p25, max(v) FILTER (WHERE r = (3 * n + 3) // 4) AS p75 FROM g GROUP BY 1, 2)
SELECT row_index, measure FROM g JOIN q USING (f, measure) WHERE v < p25 / 4 OR v > 4 * p75""",
}
