"""Small metadata files in any store that Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str):
        path, fs = self._path(name)
        stream = fs.create(path)
        stream.write(bytearray(text.encode()))
        stream.close()
        return path, fs

    def create(self, name: str, text: str) -> bool:
        """Put a file in place that wasn't there, whole or not at all; false if it was."""
        path, fs = self._path(name)
        if fs.exists(path):
            return False
        fresh, _ = self._put(f"{name}.{uuid.uuid4().hex}.new", text)
        if fs.rename(fresh, path):
            return True
        fs.delete(fresh, False)
        return False

    def latest(self, folder: str) -> tuple[int, str | None]:
        """Number and text of the last of the numbered files of a folder, 0 and null if there is none."""
        numbers = [int(n[:-5]) for n in self.names(folder) if n.endswith(".json") and n[:-5].isdigit()]
        return (max(numbers), self.read(f"{folder}/{max(numbers):012d}.json")) if numbers else (0, None)

    def replace(self, folder: str, after: int, text: str) -> bool:
        """Add the numbered file after the given one; false if another writer was first.

        Readers take the last one, so they see the old text or the new one, also if this stops at any point.
        """
        if not self.create(f"{folder}/{after + 1:012d}.json", text):
            return False
        for n in self.names(folder):
            if n[:-5].isdigit() and int(n[:-5]) < after:
                self.delete(f"{folder}/{n}")
        return True

    def write(self, name: str, text: str) -> None:
        """The text under a name, kept as numbered files in a folder of that name."""
        while not self.replace(name, self.latest(name)[0], text):
            pass

    def delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for working tables, in the shared folder that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base}/{name}-{uuid.uuid4().hex}"
