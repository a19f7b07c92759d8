"""Small files on whatever file system Spark reaches, through Hadoop's API."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def parts(self, path: str) -> list[str]:
        """Names of the files that Spark's writer left in a folder."""
        fs, p = self._at(path)
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("part-"))

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces the file in one step: a reader sees the old text or the new."""
        fs, temporary = self._at(path + ".new")
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(path + ".new", path)

    def claim(self, path: str) -> bool:
        """Makes an empty file unless there is one: of several claimants one succeeds."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        try:
            fs.create(p, False).close()
        except Exception as e:
            if fs.exists(p):
                return False
            raise e
        return True

    def age(self, path: str) -> float:
        """Seconds since the file was written."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def rename(self, old: str, new: str) -> None:
        fs, source = self._at(old)
        _, target = self._at(new)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(source), fs.makeQualified(target), options)
