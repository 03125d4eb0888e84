"""Small files in a folder that driver and executors share, by Hadoop's file systems: local, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFiles:
    """Paths are relative to ``base``. A file is made whole or not at all, and is never changed."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark._jvm
        base = str(base)
        self.base = f"file://{base}" if base.startswith("/") else base.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def url(self, name: str) -> str:
        return f"{self.base}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; nothing where there is none."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one of that name."""
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(text.encode()))
            if stream.hasCapability("hsync"):
                stream.hsync()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
