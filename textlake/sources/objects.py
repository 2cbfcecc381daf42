"""Objects by key below a folder of any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class ObjectStore:
    """put, get, exists, delete and list of single objects, through Hadoop's file systems; read() has many as a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = self.fs.makeQualified(path).toString()

    def _path(self, key: str):
        if not key.strip("/") or key.startswith("/") or any(p in ("", ".", "..") for p in key.rstrip("/").split("/")):
            raise ValueError(f"no valid key: {key!r}")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def put(self, key: str, data: bytes) -> str:
        out = self.fs.create(self._path(key), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return f"{self.root}/{key}"

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise KeyError(f"no object {key!r}")
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_text(self, key: str, text: str) -> str:
        return self.put(key, text.encode())

    def get_text(self, key: str) -> str:
        return self.get(key).decode()

    def exists(self, key: str) -> bool:
        path = self._path(key)
        return self.fs.exists(path) and self.fs.getFileStatus(path).isFile()

    def delete(self, key: str) -> None:
        if self.exists(key):
            self.fs.delete(self._path(key), False)

    def list(self, prefix: str = "") -> list[str]:
        """Sorted keys that start with prefix."""
        folder = prefix.rpartition("/")[0]
        top = self._path(folder) if folder else self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not self.fs.exists(top):
            return []
        found, files = [], self.fs.listFiles(top, True)
        while files.hasNext():
            key = files.next().getPath().toString()[len(self.base) + 1 :]
            if key.startswith(prefix) and not key.endswith(".crc"):
                found.append(key)
        return sorted(found)

    def read(self, prefix: str = "") -> DataFrame:
        """(key, data) of all objects below a folder that hold anything, in parallel."""
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{prefix}".rstrip("/"))
        return rows.selectExpr(f"substring(path, length('{self.base}') + 2) as key", "content as data")
