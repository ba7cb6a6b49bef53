"""Versioned tables: immutable Parquet parts, named by numbered manifests of which each number is put by one writer only.

A reader keeps to the version that it began with; a writer that lost the race
for a number sees the winner's version and decides again.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer put this version first, or a key has other values already."""


class Files:
    """The few file operations that manifests need, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def text(self, name: str) -> str:
        at = self.path(name)
        stream = self.fs.open(at)
        try:
            return bytes(stream.readNBytes(self.fs.getFileStatus(at).getLen())).decode()
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether this call made the file.  It appears whole or not at all: written aside, then linked or renamed onto a free name."""
        at, aside = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                # A local rename would replace a file; a hard link never does.
                nio = self.jvm.java.nio.file
                place = lambda p: nio.Paths.get(p.toUri().getPath(), empty_array(self.jvm, "java.lang.String"))
                nio.Files.createLink(place(self.fs.makeQualified(at)), place(self.fs.makeQualified(aside)))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
                context.rename(aside, at, empty_array(self.jvm, "org.apache.hadoop.fs.Options$Rename"))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.fs.delete(aside, False)


def empty_array(jvm, kind: str):
    """No further parts of a path, or no option to replace an existing file."""
    return jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName(kind), 0)


class VersionedTable:
    """A table of Parquet parts under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for x in self.files.names("versions") if (m := re.fullmatch(r"(\d{10})\.json", x)))

    def latest(self) -> int:
        """The newest version, 0 for a table that has none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """parts, schema, tags and rows of a version, the newest by default."""
        version = self.latest() if version is None else version
        return json.loads(self.files.text(f"versions/{version:010d}.json")) if version else {"version": 0, "parts": [], "schema": None, "tags": {}, "rows": 0}

    def read(self, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Rows of a version; later commits do not change what is read.  A table without versions is empty and needs a schema."""
        m = self.manifest(version)
        known = T.StructType.fromJson(m["schema"]) if m["schema"] else schema
        if known is None:
            raise ValueError("an empty table needs a schema")
        if not m["parts"]:
            return self.spark.createDataFrame([], known)
        return self.spark.read.schema(known).parquet(*[f"{self.path}/parts/{p}" for p in m["parts"]])

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/parts/{name}")

    def has_part(self, name: str) -> bool:
        """Whether a part was written to its end."""
        return self.files.exists(f"parts/{name}/_SUCCESS")

    def write_part(self, rows: DataFrame, name: str | None = None) -> str:
        """Write rows as a part that no version names yet; a part of that name that is complete stays as it is."""
        name = name or uuid.uuid4().hex
        if not self.has_part(name):
            rows.write.mode("overwrite").parquet(f"{self.path}/parts/{name}")
        return name

    def commit(self, base: int, parts: list[str], *, replace: bool = False, tags: dict | None = None) -> int:
        """Version base + 1: the parts of base, unless they are replaced, and new ones.  Conflict if another writer put it first."""
        old = self.manifest(base)
        rows = {p: self.part(p).count() for p in parts}
        kept = [] if replace else old["parts"]
        schema = self.part(parts[0]).schema.jsonValue() if parts else old["schema"]
        if old["schema"] and parts and [(f["name"], f["type"]) for f in schema["fields"]] != [(f["name"], f["type"]) for f in old["schema"]["fields"]]:
            raise ValueError("a part has other columns than the table")
        m = {"version": base + 1, "parts": [*kept, *[p for p in parts if rows[p]]], "schema": old["schema"] or schema, "tags": old["tags"] | (tags or {}), "rows": (0 if replace else old["rows"]) + sum(rows.values())}
        if not self.files.put_if_absent(f"versions/{base + 1:010d}.json", json.dumps(m, sort_keys=True)):
            raise Conflict(f"version {base + 1} is another writer's")
        return base + 1

    def merge(self, rows: DataFrame, keys: list[str], *, name: str | None = None, tags: dict | None = None, tries: int = 20) -> int:
        """Add the rows whose keys the table does not have; equal keys among them count once.  The version that has them.

        The rows are written once, with what came before them taken out; a writer
        who loses the race takes out what the winner brought and tries again.
        Repeating a merge adds nothing.
        """
        base = self.latest()
        schema = rows.schema
        once = rows.dropDuplicates(keys)
        fresh = once.join(self.read(base, schema).select(*keys), keys, "left_anti").select(rows.columns) if base else once
        part = self.write_part(fresh, name)
        for _ in range(tries):
            if not tags and not self.part(part).head(1):
                return base
            try:
                return self.commit(base, [part], tags=tags)
            except Conflict:
                seen, base = set(self.manifest(base)["parts"]), self.latest()
                brought = [p for p in self.manifest(base)["parts"] if p not in seen]
                if brought:
                    theirs = self.spark.read.parquet(*[f"{self.path}/parts/{p}" for p in brought]).select(*keys)
                    part = self.write_part(self.part(part).join(theirs, keys, "left_anti").select(rows.columns))
        raise Conflict(f"no version is free after {tries} tries")

    def replace(self, rows: DataFrame, base: int, tags: dict | None = None) -> int:
        """All rows anew as one version after base: readers see the old rows or the new ones, never a mix."""
        return self.commit(base, [self.write_part(rows)], replace=True, tags=tags)

    def compact(self, parts: int = 1) -> int:
        """The same rows in fewer files, as a new version."""
        base = self.latest()
        return self.replace(self.read(base).coalesce(parts), base) if base else 0
