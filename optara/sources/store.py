"""Small files on whatever file system a path names, through Hadoop's client, so that a run's folder may lie in a shared store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._options = spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        self._options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names of the files and folders in a folder, sorted; none if it isn't there."""
        p, fs = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole text, put in place by a rename, so that no reader sees half of it."""
        p, fs = self._at(path)
        if fs.getScheme() == "file":
            fs = fs.getRawFileSystem()  # without checksum files beside the document
        fs.mkdirs(p.getParent())
        whole = fs.makeQualified(p)
        part = self._jvm.org.apache.hadoop.fs.Path(whole.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
        stream = fs.create(part)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self._conf).rename(part, whole, self._options)

    def delete(self, path: str) -> None:
        """A file or a folder with all it holds."""
        p, fs = self._at(path)
        fs.delete(p, True)
