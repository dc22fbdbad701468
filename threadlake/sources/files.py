"""Small files of a store, in any file system Spark reaches: existence, listing, atomic creation."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _at(self, path: str):
        p = self._path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Create a file with ``text`` at once; False if another writer has created it.

        The text is written beside it and renamed, which no file system does over an existing
        file unless told so: a reader sees the whole file or none, and one of two writers wins.
        """
        target, fs = self._at(path)
        fs.mkdirs(target.getParent())
        beside = self._path(f"{target.getParent().toString()}/_{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(beside, target, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(beside, True)
            # A checksum file a local file system may have left.
            fs.delete(self._path(f"{target.getParent().toString()}/.{beside.getName()}.crc"), True)
