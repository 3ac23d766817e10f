"""Versions of a dataset: folders of data, and numbered pointers that say which folder counts.

Below the base lie data folders under names of their own, ``_versions/<number>`` (a pointer: a file that holds
the name of a folder) and ``_latest`` (a hint). A version exists once its pointer does. A pointer is written
whole under another name and then renamed to the next free number, which fails if another writer has taken
that number meanwhile; the loser goes on to the one after it. So a write that breaks off leaves the dataset as
it was, and readers neither list folders nor compare clocks: they go up from the hint to the last pointer.

A rename that refuses an existing target is atomic on HDFS and on stores with conditional writes. On a local
file system, as in tests, it is guarded within one driver process only.
"""

from __future__ import annotations

import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_renames = threading.Lock()


class Conflict(Exception):
    """Another version has been published since the one that a write was based on."""


class _Files:
    """The few file operations that versions need, through Hadoop, so that any store of Spark will do."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self.path(base).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), True)
        stream.write(text.encode())
        stream.close()

    def rename_if_free(self, name: str, target: str) -> bool:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        source, free = self._fs.makeQualified(self.path(name)), self._fs.makeQualified(self.path(target))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf)
        with _renames:
            if self.exists(target):
                return False
            try:
                context.rename(source, free, options)
            except Exception:
                # taken between the look and the rename, which tells so; anything else is an error
                if not self.exists(target):
                    raise
                return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), False)


def _pointer(base: str, number: int) -> str:
    return f"{base}/_versions/{number:010d}"


def new_folder(base: str) -> str:
    """Where to write the data of a version to be."""
    return f"{base}/data-{uuid.uuid4().hex}"


def _last(files: _Files, base: str) -> int:
    # another writer may be at the hint just now: a torn or missing one only makes the way longer
    try:
        text = files.read(f"{base}/_latest").strip()
    except Py4JJavaError:
        text = ""
    number = int(text) if text.isdigit() else 0
    if number and not files.exists(_pointer(base, number)):
        number = 0
    while files.exists(_pointer(base, number + 1)):
        number += 1
    return number


def last_version(spark: SparkSession, base: str) -> int:
    """The number of the latest version, 0 if there is none."""
    return _last(_Files(spark, base), base)


def folder_of(spark: SparkSession, base: str, number: int) -> str:
    """The data folder of a version."""
    return f"{base}/{_Files(spark, base).read(_pointer(base, number)).strip()}"


def current_folder(spark: SparkSession, base: str) -> str:
    """The data folder of the latest version."""
    number = last_version(spark, base)
    if not number:
        raise FileNotFoundError(f"no version below {base}")
    return folder_of(spark, base, number)


def publish(spark: SparkSession, base: str, folder: str, after: int | None = None) -> int:
    """Make the written ``folder`` the next version and return its number.

    With ``after`` it must be the one that follows that version, else the write is refused.
    """
    files = _Files(spark, base)
    waiting = f"{base}/_versions/.{uuid.uuid4().hex}"
    files.write(waiting, folder.rsplit("/", 1)[1])
    number = _last(files, base) + 1 if after is None else after + 1
    while not files.rename_if_free(waiting, _pointer(base, number)):
        if after is not None:
            files.delete(waiting)
            raise Conflict(f"version {number} of {base} has been published by another writer")
        number += 1
    try:
        files.write(f"{base}/_latest", str(number))
    except Py4JJavaError:
        pass  # two writers at the hint at once: the version is published all the same
    return number
