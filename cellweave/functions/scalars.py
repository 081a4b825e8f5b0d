"""Column expressions and small parsers."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest stored value.
MOST = 65_535


def quantise(value: Column) -> Column:
    """Value as stored: clamped to 0 .. 65535, rounded half up; NaN counts 0."""
    return F.floor(F.least(F.greatest(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(float(MOST))) + 0.5).cast("int")


def parse_value(text: Column) -> Column:
    """Number of a matrix file's third column: no text gives 1, text without a number (also nan, inf) gives 0."""
    number = text.try_cast("double")
    finite = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(0.0)).otherwise(number)
    return F.when(text.isNull() | (text == ""), F.lit(1.0)).otherwise(finite)


def scaling_factor(total: Column, target: float = 10_000.0) -> Column:
    """target / total where total is above 0, else null."""
    return F.when(total > 0, F.lit(target) / total).cast("float")


def decode_category(code: Column, categories: Column) -> Column:
    """Category at a code counted from 0; codes below 0 or beyond the categories give null."""
    return F.when((code >= 0) & (code < F.size(categories)), F.try_element_at(categories, (code + 1).cast("int")))


def chunk_of(row: Column, size: int) -> Column:
    """Number of the chunk that a row or column lies in."""
    return F.floor(row / F.lit(size)).cast("int")


def local_row(row: Column, size: int) -> Column:
    return F.pmod(row, F.lit(size))


def joined_sorted(names: Column, separator: str = ", ") -> Column:
    """Names in order, joined; an empty or null list gives ''."""
    return F.coalesce(F.array_join(F.array_sort(names), separator), F.lit(""))


def natural(names: list[str]) -> list[str]:
    """Names ordered by their numbers rather than letter by letter."""
    return sorted(names, key=lambda n: ([int(x) for x in re.findall(r"\d+", os.path.basename(n))], n))


def row_range(name: str) -> tuple[int, int] | None:
    """(a, b) of ``rows_a_b`` or ``cols_a_b``."""
    m = re.search(r"(?:rows|cols)_(\d+)_(\d+)", os.path.basename(name))
    return (int(m.group(1)), int(m.group(2))) if m else None


def available_memory() -> int:
    """Bytes of memory free for results; 32 GiB where the system does not say."""
    try:
        import psutil

        return int(psutil.virtual_memory().available)
    except ImportError:
        pass
    try:
        with open("/proc/meminfo") as f:
            for line in f:
                if line.startswith("MemAvailable:"):
                    return int(line.split()[1]) * 1024
    except OSError:
        pass
    return 32 << 30


def size_units(n_bytes: float) -> dict[str, float]:
    return {"bytes": n_bytes, "mb": n_bytes / 1024**2, "gb": n_bytes / 1024**3}
