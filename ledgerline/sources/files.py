"""Small files on the shared store, through Hadoop's file system: any path that Spark can write will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Text files and folders below ``root``, from the driver. Files come into being whole: written aside, then renamed over the old one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        """What lies in a folder, sorted; nothing where there is none."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        """Replaces the file at once: a reader sees the old content or the new."""
        aside, target = self._path(f"{name}.{uuid.uuid4().hex}.new"), self._path(name)
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), options)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
