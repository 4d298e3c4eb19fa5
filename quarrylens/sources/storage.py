"""Small files in a shared folder through Hadoop's file systems, so that any store Spark can write to will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URI. ``claim`` is the one atomic step: it writes a small file unless that file is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def fingerprint(self) -> list[list]:
        """Name, size and time of the files that stand here, or of the file itself."""
        return sorted([s.getPath().getName(), s.getLen(), s.getModificationTime()] for s in self._fs.listStatus(self._path("")))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Write a small file; false where it is there already."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
