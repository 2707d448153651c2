"""Shared-storage helpers used by the operators that write intermediate tables or archives."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; what is left of it goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/keystrand/{name}-{uuid.uuid4().hex}"
    atexit.register(lambda: _quietly(spark, path))
    return path


def _quietly(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder on any Hadoop file system."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to shared storage and read it back: a cut of the lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra ones never clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def crc_bucket(id_col: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they need not find it on a path of their own."""
    context = spark.sparkContext
    if getattr(context, "_keystrand_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="keystrand-code-")) / "keystrand_code.zip"
    with zipfile.ZipFile(to, "w") as out:
        for x in sorted(top.rglob("*.py")):
            out.write(x, x.relative_to(top.parent))
    context.addPyFile(str(to))
    context._keystrand_shipped = True


def _trim() -> None:
    """Give freed memory back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand on the workers, which keep no freed memory after a task."""
    ship(df.sparkSession)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(task, schema)
