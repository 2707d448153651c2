"""Small files on any Hadoop file system."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength() if self.exists(folder) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write aside, then rename: readers see all or nothing.  An existing name is an error."""
        aside = f"{name}.tmp"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self._path(aside), self._path(name)):
            raise FileExistsError(f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of its file system, Hadoop's default one where it names none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.  Only a local master may go without; elsewhere that is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/keystrand-scratch"
    return qualified(spark, root).rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below :func:`shared_folder`; removed when Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        with suppress(Exception):
            Files(spark, path).delete("")

    atexit.register(clean)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read back: evaluated once, however often the result is used."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
