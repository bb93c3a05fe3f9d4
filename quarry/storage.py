"""Small files of a workspace through Hadoop's FileSystem, so that a folder may lie in any store the cluster knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Text files and folders below ``root``, a path or URI; tables are read and written by Spark itself."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), str(root).rstrip("/")

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _open(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(self.at(name))
        return path.getFileSystem(self.conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._open(name)
        return fs.exists(path)

    def make(self, name: str = "") -> None:
        fs, path = self._open(name)
        fs.mkdirs(path)

    def names(self, name: str = "") -> list[str]:
        fs, path = self._open(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        fs, path = self._open(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """A file that appears whole or not at all; one of that name must not exist."""
        fs, path = self._open(name)
        if fs.exists(path):
            raise FileExistsError(self.at(name))
        _, draft = self._open(f"{name}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(draft, path):
            raise FileExistsError(self.at(name))

    def delete(self, name: str) -> bool:
        fs, path = self._open(name)
        return fs.delete(path, True)
