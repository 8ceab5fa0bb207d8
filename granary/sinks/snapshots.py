"""Folders that change together: numbered versions, each told by one pointer file.

Data is written to folders of its own that nothing refers to yet. A commit adds one small file, the pointer of the next
version, with the folders that make up each table. A reader takes the newest pointer and sees all tables
as of that version; there is no moment at which one of them is missing or newer than the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sinks.publish import _fs, children, path_exists, remove


class CommitConflict(RuntimeError):
    """Another writer has made the version that this commit was to become."""


@dataclass(frozen=True)
class Version:
    """Folders of each table below the store's root, and numbers that belong to the version."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    values: dict[str, int] = field(default_factory=dict)


class Snapshots:
    """A store of versioned tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, number: int) -> str:
        return f"{self.root}/_versions/{number:010d}.json"

    def versions(self) -> list[int]:
        names = [c.rpartition("/")[2] for c in children(self.spark, f"{self.root}/_versions")]
        return sorted(int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, the newest one by default; an empty store is version 0."""
        if number is None:
            number = max(self.versions(), default=0)
        if number == 0:
            return Version()
        fs, path = _fs(self.spark, self._pointer(number))
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        kept = json.loads(text)
        return Version(number, kept["folders"], kept["values"])

    def new_folder(self) -> str:
        """Name of a folder to write to, relative to the root."""
        return f"data/load=v{uuid.uuid4().hex}"

    def path(self, folder: str) -> str:
        return f"{self.root}/{folder}"

    def commit(self, base: Version, folders: dict[str, list[str]], values: dict[str, int] | None = None) -> Version:
        """Publish the version after ``base``; fails if another writer has done so meanwhile."""
        made = Version(base.number + 1, folders, base.values if values is None else values)
        fs, target = _fs(self.spark, self._pointer(made.number))
        _, staged = _fs(self.spark, f"{self.root}/_versions/_{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(staged, True)
        try:
            out.write(bytearray(json.dumps({"folders": made.folders, "values": made.values}).encode()))
        finally:
            out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # A rename that does not replace: of two writers one fails.
            context.rename(fs.makeQualified(staged), fs.makeQualified(target), gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as error:
            remove(self.spark, staged.toString())
            if path_exists(self.spark, target.toString()):
                raise CommitConflict(f"version {made.number} of {self.root} exists") from error
            raise
        return made

    def load(self, table: str, write: Callable[[str], None], append: bool = False) -> Version:
        """Write a folder and make it the table, or a further part of it. A failed write leaves the table as it was."""
        return self.load_all({table: write}, append)

    def load_all(self, tables: dict[str, Callable[[str], None]], append: bool = False) -> Version:
        """As :meth:`load` for several tables, which change in one commit."""
        base = self.version()
        folders, made = dict(base.folders), []
        try:
            for table, write in tables.items():
                folder = self.new_folder()
                made.append(folder)
                write(self.path(folder))
                folders[table] = [*(base.folders.get(table, []) if append else []), folder]
            return self.commit(base, folders)
        except BaseException:
            for folder in made:
                remove(self.spark, self.path(folder))
            raise

    def read(self, tables: str | Iterable[str], schema: T.StructType | str, number: int | None = None) -> DataFrame:
        """Rows of one or more tables in a version; none if the version does not have them."""
        names = [tables] if isinstance(tables, str) else list(tables)
        kept = self.version(number).folders
        paths = [self.path(f) for name in names for f in kept.get(name, [])]
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", self.path("data")).parquet(*paths)
        return found.select(*[F.col(f"`{n}`") for n in schema.names])

    def rollback(self, number: int) -> Version:
        """Make an earlier version the newest one again; those in between stay readable by number."""
        if number not in self.versions():
            raise ValueError(f"no version {number} in {self.root}")
        old = self.version(number)
        return self.commit(self.version(), old.folders, old.values)

    def expire(self, keep: int = 10) -> None:
        """Forget all but the newest ``keep`` versions, and delete the folders that only those had."""
        if keep < 1:
            raise ValueError("at least one version stays")
        numbers = self.versions()
        old, kept = [self.version(n) for n in numbers[:-keep]], [self.version(n) for n in numbers[-keep:]]
        used = {f for v in kept for own in v.folders.values() for f in own}
        for v in old:
            remove(self.spark, self._pointer(v.number))
        for folder in {f for v in old for own in v.folders.values() for f in own} - used:
            remove(self.spark, self.path(folder))
