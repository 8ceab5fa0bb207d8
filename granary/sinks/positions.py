"""Deletion by position: rows are marked by file and row number, and files rewritten later, a bounded number at a time.

A table is a folder of Parquet files. Marks are Parquet files of (file, row_index) below ``_deletes``, which readers of the
folder skip; :func:`read_live` leaves marked rows out. :func:`merge_deletes` replaces files by what is left of them. Each
pass of it writes down what it is about to do before it touches the table, so a pass that was
cut off anywhere is finished by the next call, and marks of files that are gone mean nothing.
"""

from __future__ import annotations

import itertools
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sinks.publish import children, move, path_exists, publish_new, remove

MARK = "file string, row_index long"
_PASS = "_merge_"
#: Files replaced in one pass; their names go through the driver.
FILES_PER_PASS = 1000


def with_place(df: DataFrame) -> DataFrame:
    """Rows of a Parquet scan with the file and row number that deletion marks use."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def mark_deleted(rows: DataFrame, path: str, name: str, notes: list[str] | None = None) -> str:
    """Mark ``rows``, from :func:`with_place`, as deleted from the table at ``path``. No data file is touched.

    ``name`` makes the deletion repeatable: marks of that name which are there already stay as they are. Columns in ``notes``
    are kept with the marks.
    """
    target = f"{path.rstrip('/')}/_deletes/{name}"
    spark = rows.sparkSession
    if path_exists(spark, target):
        return target
    marks = rows.select(F.col("_file").alias("file"), F.col("_row").alias("row_index"), *(notes or []))
    return publish_new(spark, target, lambda staged: marks.write.parquet(staged))


def deleted_places(spark: SparkSession, path: str) -> DataFrame:
    """All marks of a table."""
    entries = [c for c in children(spark, f"{path.rstrip('/')}/_deletes") if not c.rpartition("/")[2].startswith("_")]
    return spark.read.schema(MARK).parquet(*entries) if entries else spark.createDataFrame([], MARK)


def read_live(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a table that are not marked as deleted.

    The marks join by file and row number; Spark sends them to the tasks where they are few and shuffles
    both sides where they are many, until a merge has taken them away.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return _unmarked(reader.parquet(path), deleted_places(spark, path))


def _unmarked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    placed = with_place(rows)
    gone = marks.distinct()
    return placed.join(gone, (placed["_file"] == gone["file"]) & (placed["_row"] == gone["row_index"]), "left_anti").select(
        *[F.col(f"`{c}`") for c in rows.columns])


def merge_deletes(spark: SparkSession, path: str, files_per_pass: int = FILES_PER_PASS) -> int:
    """Rewrite all files with marks, ``files_per_pass`` at a time, and drop the marks; returns how many files were replaced.

    Rows that arrive meanwhile are in other files and stay. A table without marks is left alone.
    """
    path = path.rstrip("/")
    finish_passes(spark, path)
    marks, replaced = deleted_places(spark, path), 0
    schema = spark.read.parquet(path).schema if not marks.isEmpty() else None
    if schema is not None:
        names = marks.select("file").distinct().orderBy("file").toLocalIterator()
        while some := [unquote(r[0]) for r in itertools.islice(names, files_per_pass)]:
            # Files that an earlier pass has replaced are gone, and their marks join nothing.
            files = [f for f in some if path_exists(spark, f)]
            if files:
                kept = _unmarked(spark.read.schema(schema).option("basePath", path).parquet(*files), marks)
                _replace(spark, path, files, kept, schema)
                replaced += len(files)
    remove(spark, f"{path}/_deletes")
    return replaced


def _replace(spark: SparkSession, path: str, files: list[str], kept: DataFrame, schema: T.StructType) -> None:
    """One pass: write what is left of ``files`` and their names, then put the one in the place of the others."""
    root = _qualified(spark, path)
    folders = {_qualified(spark, f)[len(root) :].strip("/").rpartition("/")[0] for f in files}
    columns = [p.partition("=")[0] for p in next(iter(folders)).split("/") if "=" in p]
    plan = f"{path}/{_PASS}{uuid.uuid4().hex}"

    def write(staged: str) -> None:
        kept.write.partitionBy(*columns).parquet(f"{staged}/new")
        spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{staged}/old")

    publish_new(spark, plan, write)
    _finish(spark, path, plan)


def _qualified(spark: SparkSession, path: str) -> str:
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toString()


def finish_passes(spark: SparkSession, path: str) -> None:
    """Carry passes that were cut off to their end."""
    for plan in children(spark, path):
        if plan.rpartition("/")[2].startswith(_PASS):
            _finish(spark, path, plan)


def _finish(spark: SparkSession, path: str, plan: str) -> None:
    """Every step can be done again: old files go, new ones come in under names of their own, then the plan goes."""
    for (file,) in spark.read.schema("file string").parquet(f"{plan}/old").collect():
        if path_exists(spark, file):
            remove(spark, file)
    for file, folder in _data_files(spark, f"{plan}/new"):
        move(spark, file, f"{path.rstrip('/')}/{folder}{file.rpartition('/')[2]}")
    remove(spark, plan)


def _data_files(spark: SparkSession, folder: str, below: str = "") -> list[tuple[str, str]]:
    out = []
    for child in children(spark, folder):
        name = child.rpartition("/")[2]
        if "=" in name:
            out += _data_files(spark, child, f"{below}{name}/")
        elif name.startswith("part-"):
            out.append((child, below))
    return out
