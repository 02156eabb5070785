"""Metadata and groups of tables that are replaced as one.

A file is written beside its place under a name of its own and renamed into it,
which the file system does at once: readers see the old file or the new one. A
group of tables gets a folder for each version; a version counts from the
moment that its numbered entry is renamed into ``versions``, after all of its
tables were written. Renaming does not replace an entry, so of two writers that
began from the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lexiweave.runtime import delete


class Conflict(RuntimeError):
    """Somebody else has put a file, or committed a version, in the meantime."""


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, text: str, path: str, replace: bool = True) -> None:
    """Put a small file in its place in one step; without ``replace``, ``Conflict`` if there is one already."""
    jvm = spark._jvm
    fs, target = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    target = fs.makeQualified(target)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    try:
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, how)
        except Py4JJavaError as error:
            if not replace and error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"{path} is there already") from None
            raise
    finally:
        fs.delete(beside, False)


class Versions:
    """A group of tables under ``root`` that are written and read together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, folder = _file_system(self.spark, f"{self.root}/versions")
        found = fs.listStatus(folder) if fs.exists(folder) else []
        names = [f.getPath().getName() for f in found]
        return sorted(int(n.removesuffix(".json")) for n in names if not n.startswith("."))

    def current(self) -> int:
        """The number of the newest version, 0 if there is none."""
        return max(self._numbers(), default=0)

    def _entry(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/versions/{version:08d}.json"))

    def commit(self, tables: Mapping[str, DataFrame], base: int | None = None) -> int:
        """Write all tables and make them the version behind ``base`` (the current one, if None), which they may be read from."""
        base = self.current() if base is None else base
        folder = f"tables/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        entry = {"folder": folder, "tables": {name: df.schema.json() for name, df in tables.items()}}
        put_text(self.spark, json.dumps(entry), f"{self.root}/versions/{base + 1:08d}.json", replace=False)
        return base + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the current one if None."""
        from pyspark.sql.types import StructType

        entry = self._entry(self.current() if version is None else version)
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["tables"][name]))).parquet(f"{self.root}/{entry['folder']}/{name}")

    def clear(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions, entries first, and folders that no version has; nobody may be writing."""
        numbers = self._numbers()
        for n in numbers[: len(numbers) - keep]:
            delete(self.spark, f"{self.root}/versions/{n:08d}.json")
        used = {self._entry(n)["folder"] for n in self._numbers()}
        fs, folder = _file_system(self.spark, f"{self.root}/tables")
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            if f"tables/{f.getPath().getName()}" not in used:
                fs.delete(f.getPath(), True)
