"""Session helpers: shared scratch folders, and how the package reaches the Python workers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, the context's checkpoint folder, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='seqengine-')}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it is removed at the end of `temporary_tables`, or when the driver process ends."""
    path = f"{shared_dir(spark)}/seqengine-{uuid.uuid4().hex[:12]}-{name}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: this cuts the lineage, and the
    table outlives lost executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _there(spark: SparkSession, path: str):
    """A path and its file system, for the driver."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    where, system = _there(spark, path)
    system.mkdirs(where)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Gives a folder another name, within one file system."""
    (where, system), (to, _) = _there(spark, old), _there(spark, new)
    if not system.rename(where, to):
        raise OSError(f"{old} could not be moved to {new}")


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            where, system = _there(spark, path)
            system.delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Scratch tables that are made inside go at its end; results that read them must have been written or collected by then."""
    before = len(_scratch)
    try:
        yield
    finally:
        _remove(_scratch[before:])
        del _scratch[before:]


atexit.register(_remove, _scratch)


def let_go(spark: SparkSession) -> None:
    """Has Spark remove the broadcast tables and shuffle files of queries that are over from the executors.

    It does so when the driver's JVM has collected what refers to them, which may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once in each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="seqengine-"), "seqengine_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
