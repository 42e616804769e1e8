"""Files of a workspace through Hadoop's file system, so that any store Spark reads will do; and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Small text files and folders below a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.path(*parts)))

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.path(*parts)), True)

    def folders(self) -> list[str]:
        root = self._path(self.root)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root) if f.isDirectory()) if self._fs.exists(root) else []

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(self.path(*parts)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def files(self, *parts: str) -> list[str]:
        folder = self._path(self.path(*parts))
        return [f.getPath().getName() for f in self._fs.listStatus(folder) if f.isFile()] if self._fs.exists(folder) else []

    def create(self, text: str, *parts: str) -> bool:
        """A new file, complete as soon as it is there: written under another name, then renamed.  False if it is there already."""
        target, new = self._path(self.path(*parts)), self._path(self.path(*parts) + ".new")
        if self._fs.exists(target):
            return False
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return self._fs.rename(new, target)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; unset, a temporary folder serves in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
