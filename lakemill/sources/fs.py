"""The few file operations that tables and reports need, on any Hadoop file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Exists(RuntimeError):
    """A file that was to be new is there already."""


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def listing(self, path: str) -> list[tuple[str, str, int]]:
        """(path, name, bytes) of what is in a folder, by name."""
        found = self.fs.listStatus(self._path(path)) if self.exists(path) else []
        return sorted((s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in found)

    def names(self, path: str) -> list[str]:
        return [name for _, name, _ in self.listing(path)]

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def first_line(self, path: str) -> str:
        lines = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(self.fs.open(self._path(path)), "UTF-8"))
        try:
            return lines.readLine() or ""
        finally:
            lines.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> None:
        stream = self.fs.create(self._path(path), overwrite)
        stream.write(bytearray(text.encode()))
        stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes aside, then renames; raises ``Exists`` if ``path`` is there."""
        parent, name = path.rsplit("/", 1)
        aside = f"{parent}/.{name}.{uuid.uuid4().hex}"
        self.write(aside, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(aside), self._path(path), options)
        except Py4JJavaError as e:
            self.fs.delete(self._path(aside), False)
            raise Exists(path) from e


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files in a folder."""
    return spark.createDataFrame([(name, size) for _, name, size in Files(spark, path).listing(path)], "name string, size long")
