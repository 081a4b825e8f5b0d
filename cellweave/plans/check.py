"""Checking a directory of sources before a build."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass, field

from cellweave.operators.obs import column_report
from cellweave.sources.files import discover, open_source

REPORT = "obs_report.csv"
#: Genes in common with the sources before, below which a warning is due.
LEAST_OVERLAP = 10_000


@dataclass
class Report:
    sources: list[str] = field(default_factory=list)
    gene_counts: dict[str, int] = field(default_factory=dict)
    union_genes: int = 0
    common_genes: int = 0
    without_barcode: list[str] = field(default_factory=list)
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)
    csv_path: str | None = None


def check_directory(directory: str, least_overlap: int = LEAST_OVERLAP) -> Report:
    """Genes, barcodes and metadata columns of all sources; writes ``obs_report.csv`` into the directory.

    A missing directory is a FileNotFoundError, a file a ValueError; without sources there is a
    message and no file.
    """
    sources = discover(directory)
    report = Report()
    if not sources:
        report.messages.append(f"no Zarr or HDF5 source in {directory}")
        return report
    union: set[str] = set()
    common: set[str] | None = None
    columns: dict[str, list[str]] = {}
    for s in sources:
        report.sources.append(s.name)
        try:
            source = open_source(s.path)
            genes = {g for g in source.genes() if g is not None}
        except (ValueError, ImportError, OSError) as e:
            report.messages.append(f"{s.name}: {e}")
            genes = None
        if genes is not None:
            report.gene_counts[s.name] = len(genes)
            shared = len(genes & union)
            if union and shared < least_overlap:
                report.messages.append(f"{s.name}: only {shared} genes in common with the sources before")
            union |= genes
            common = genes if common is None else common & genes
        try:
            stem = os.path.splitext(s.name)[0]
            columns[stem] = sorted(open_source(s.path).obs_types())
            if "barcode" not in columns[stem]:
                report.without_barcode.append(s.name)
        except (ValueError, ImportError, OSError) as e:
            report.messages.append(f"{s.name}: {e}")
    report.union_genes, report.common_genes = len(union), len(common or ())
    report.columns = column_report(columns)
    if report.columns:
        report.csv_path = os.path.join(directory, REPORT)
        with open(report.csv_path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(["dataset_name", "common_columns", "unique_columns"])
            out.writerows(report.columns)
    else:
        report.messages.append("no source has metadata columns")
    return report
