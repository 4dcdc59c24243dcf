"""Small files of the driver, on any file system that Spark reads or on the local disk."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


class LocalFiles:
    """The local disk, for folders that only this process uses."""

    def exists(self, path: str) -> bool:
        return Path(path).exists()

    def read(self, path: str) -> bytes:
        return Path(path).read_bytes()

    def create(self, path: str, data: bytes) -> None:
        """Writes a new file; an error if there is one."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "xb") as f:
            f.write(data)

    def rename(self, path: str, to: str) -> None:
        os.replace(path, to)

    def remove(self, path: str) -> None:
        Path(path).unlink(missing_ok=True)


class SparkFiles:
    """Any file system that the session's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):  # noqa: ANN202
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        files, where = self._at(path)
        return files.exists(where)

    def read(self, path: str) -> bytes:
        files, where = self._at(path)
        stream = files.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        files, where = self._at(path)
        stream = files.create(where, False)
        stream.write(bytearray(data))
        stream.close()

    def rename(self, path: str, to: str) -> None:
        _, where = self._at(path)
        _, target = self._at(to)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.getFileSystem(self.conf).getUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        context.rename(where, target, over)

    def remove(self, path: str) -> None:
        files, where = self._at(path)
        files.delete(where, True)


def retried(act: Callable[[], None], tries: int = 5, wait: float = 0.1) -> None:
    """Again after an error of the file system, with growing pauses; the last error stays."""
    from py4j.protocol import Py4JJavaError

    for k in range(tries):
        try:
            return act()
        except (OSError, Py4JJavaError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    return None


def write_whole(files: LocalFiles | SparkFiles, path: str, data: bytes, tries: int = 5) -> None:
    """A reader finds the old file or the new one, never a part: written aside, then renamed over it."""
    aside = f"{path}.{os.getpid()}-{time.monotonic_ns()}.part"
    files.create(aside, data)
    try:
        retried(lambda: files.rename(aside, path), tries)
    except BaseException:
        files.remove(aside)
        raise
