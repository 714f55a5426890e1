"""Session helpers: table access, tables written in shared storage, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only up to this many rows, counted or known from a bound.
BROADCAST_ROWS = 200_000
#: Spark removes the shuffle files of a finished query at once under this setting, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir` (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the context's, or the one named in spark.checkpoint.dir.

    Where neither is set a local folder does for a local master, as in tests; on a cluster that raises RuntimeError, as
    executors can't share a driver's local folder.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loadstone-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def _files_let_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def materialize(df: DataFrame) -> DataFrame:
    """Compute `df` once into a table below the shared checkpoint folder and read it from there, without its lineage.

    The files survive the loss of executors; the shuffle files of the computation are removed at its end. discard() removes
    the table.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with _files_let_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loadstone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing will be computed from it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._loadstone_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration() if hasattr(spark, "_jsc") else spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_within(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of `df` if it has at most `limit` rows, counted up to there; else leave the choice to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
