"""Session helpers: shared folder, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session has none (tests, local mode) one is made for this process; on a
    cluster the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.environ.get("CELLWEAVE_LOCAL_SHARED") or tempfile.mkdtemp(prefix="cellweave-")
        os.environ["CELLWEAVE_LOCAL_SHARED"] = folder
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that it is computed once and survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
        own = mounted(spark, sc._jsc.sc().getCheckpointDir().get())
        if own:
            _remove_later(own)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder as Parquet and read from there, so that later passes read only the columns they use; removed at exit."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark), "cellweave-" + uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(str(path.toString()))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(str(path.toString()))


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The folder as a plain path if Spark resolves it to a mounted file system, else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return str(system.makeQualified(path).toUri().getPath()) if system.getScheme() == "file" else None


def _remove_later(folder: str) -> None:
    """Remove the folder when this process ends."""
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def local_folder(spark: SparkSession) -> str | None:
    """A fresh folder in the shared folder as a plain path, or None if that is not on a mounted file system; removed at exit."""
    base = mounted(spark, shared_dir(spark))
    if base is None:
        return None
    path = os.path.join(base, "cellweave-" + uuid.uuid4().hex)
    os.makedirs(path, exist_ok=True)
    _remove_later(path)
    return path


def small_rows(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` if there are at most ``most``, else None; never more than most + 1 reach the driver."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def bounded(df: DataFrame, most: int) -> bool:
    """Has the table at most so many rows? Counted where they are."""
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = 200_000, salt: int = 1) -> DataFrame:
    """Join that broadcasts ``right`` only if it has at most ``most`` rows; beyond, a shuffled join.

    ``right`` is computed once, into the shared folder; its rows do not pass through the driver's Python. An inner
    shuffled join is spread over ``salt`` parts of each key, so that a key of very many rows on the
    left stands in as many tasks.
    """
    right = cut(right)
    if bounded(right, most):
        return left.join(F.broadcast(right), on, how)
    if salt == 1 or how != "inner":
        return left.join(right, on, how)
    keys = [on] if isinstance(on, str) else list(on)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c not in keys] or [F.lit(0)]), F.lit(salt)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for the workers of a session whose Python path lacks it; once per context."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (os.getcwd() == root and spark.sparkContext.master.startswith("local")):
        return
    name = f"cellweave-{spark.sparkContext.applicationId}.zip"
    if any(str(f).endswith(name) for f in spark.sparkContext.listFiles):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark), f"{uuid.uuid4().hex}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    system.deleteOnExit(path.getParent())
    spark.sparkContext.addPyFile(str(system.makeQualified(path).toString()))
