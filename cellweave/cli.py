"""Command line: check, build, build-mtx, align, obs, export-blocks, info."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cellweave").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check", help="look through a directory of sources")
    c.add_argument("directory")
    b = sub.add_parser("build", help="build a dataset out of a directory of sources")
    b.add_argument("directory")
    b.add_argument("output")
    b.add_argument("--genes")
    for name in ("block-rows", "max-rows", "max-columns", "min-nnz"):
        b.add_argument(f"--{name}", type=int)
    b.add_argument("--obs-strategy", default="outer", choices=("outer", "inner", "columns"))
    b.add_argument("--obs-join-on", nargs="*")
    b.add_argument("--obs-name", default="obs.parquet")
    b.add_argument("--keep-stage", action="store_true")
    b.add_argument("--only", help="manifest: build of the sources that it names")
    m = sub.add_parser("build-mtx", help="build a dataset out of matrix files")
    m.add_argument("path")
    m.add_argument("output")
    a = sub.add_parser("align", help="write the aligned entries as Parquet")
    a.add_argument("directory")
    a.add_argument("genes")
    a.add_argument("output")
    o = sub.add_parser("obs", help="write the joined metadata as Parquet")
    o.add_argument("directory")
    o.add_argument("output")
    o.add_argument("--strategy", default="outer", choices=("outer", "inner", "columns"))
    o.add_argument("--join-on", nargs="*")
    o.add_argument("--only", help="manifest: join the metadata of the sources that it names")
    e = sub.add_parser("export-blocks", help="write the row layout as block files")
    e.add_argument("dataset")
    e.add_argument("target")
    i = sub.add_parser("info", help="describe a dataset")
    i.add_argument("dataset")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from cellweave.operators import matrix
    from cellweave.plans import check, pipeline, store
    from cellweave.sources import readers
    from cellweave.sources.files import discover, open_source

    try:
        if args.command == "check":
            report = check.check_directory(args.directory)
            print(json.dumps(report.__dict__, indent=1, default=list))
        elif args.command == "build":
            print(json.dumps(pipeline.build_dataset(_session(), args.directory, args.output, args.genes, args.block_rows, args.max_rows, args.max_columns, args.obs_strategy, args.obs_join_on, args.obs_name, args.min_nnz, not args.keep_stage, only=args.only), indent=1))
        elif args.command == "build-mtx":
            print(json.dumps(pipeline.build_from_mtx(_session(), args.path, args.output), indent=1))
        elif args.command == "align":
            x, _, _ = pipeline.align_sources(_session(), discover(args.directory), readers.read_genes(args.genes))
            x.write.mode("overwrite").parquet(args.output)
        elif args.command == "obs":
            spark, sources = _session(), discover(args.directory)
            sources = pipeline.in_manifest(sources, args.only) if args.only else sources
            sizes = [open_source(s.path).n_rows for s in sources]
            offsets = pipeline.source_offsets(spark.createDataFrame([(s.number, n) for s, n in zip(sources, sizes)], "source_no int, n_rows long"))
            stats = matrix.row_stats(pipeline.global_rows(readers.read_matrix(spark, sources, sizes), offsets))
            pipeline.build_obs(spark, sources, sizes, offsets, stats, args.strategy, args.join_on).write.mode("overwrite").option("compression", "zstd").parquet(args.output)
        elif args.command == "export-blocks":
            print(pipeline.export_blocks(_session(), args.dataset, args.target))
        else:
            print(json.dumps(store.read_meta(args.dataset), indent=1))
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
