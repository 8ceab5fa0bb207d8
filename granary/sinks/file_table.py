"""The table of archived files, merged in place by (configuration, month)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.archive import as_archival_files, upsert_files
from granary.operators.retention import CONFIG
from granary.schemas import ARCHIVAL_FILE
from granary.sinks.publish import children, remove
from granary.sinks.snapshots import Snapshots, Version

KEY = [CONFIG, "as_of_date", "blob_path"]
#: Month of files without a date, and configuration of files without one.
NONE = "none"
_PARTS = ["part_config", "part_month"]


class FileTable:
    """File rows below ``root``, one folder per configuration and month.

    A merge rewrites only the folders that incoming rows belong to and publishes them in one version; all other
    folders, and the files in them, stay as they are. Known files keep their id, new ones are numbered after the last
    id, which the version remembers. Merging the same rows again changes nothing but the version.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Snapshots(spark, root)

    def read(self, version: int | None = None) -> DataFrame:
        """All files, or those of one earlier version."""
        return self.store.read(self.store.version(version).folders, ARCHIVAL_FILE, version)

    def merge(self, rows: DataFrame, updated: str = "created_at_et", done: dict[str, int] | None = None) -> Version:
        """Insert or update ``rows`` by configuration, date and path; among versions of a file the greatest ``updated`` wins.

        ``done`` are numbers to keep with the version; if the newest version has them already, nothing happens, so a
        batch that runs again after a failure is merged once.
        """
        base = self.store.version()
        if done and all(base.values.get(k, -1) >= v for k, v in done.items()):
            return base
        folder = self.store.new_folder()
        month = F.coalesce(F.date_format("as_of_date", "yyyy-MM"), F.lit(NONE))
        parts = [F.coalesce(F.col(CONFIG).cast("string"), F.lit(NONE)).alias(_PARTS[0]), month.alias(_PARTS[1])]
        incoming, names = as_archival_files(rows), []
        if base.folders:
            incoming = self._staged(incoming)
            # One name per folder that is hit: configurations times months at most.
            names = [f"{c}/{m}" for c, m in incoming.select(*parts).distinct().toLocalIterator()]
        known = self.store.read(sorted(n for n in names if n in base.folders), ARCHIVAL_FILE, base.number)
        newest = upsert_files(known, incoming.withColumn("id", F.lit(None).cast("long")), updated, kept=("id",))
        merged, last = self._numbered(newest, base.values.get("last_id", 0))
        merged.select(*ARCHIVAL_FILE.names, *parts).write.partitionBy(*_PARTS).parquet(self.store.path(folder))
        return self.store.commit(base, base.folders | self._made(folder), base.values | {"last_id": last} | (done or {}))

    def _made(self, folder: str) -> dict[str, list[str]]:
        """The folders of each configuration and month that a merge has written."""
        made = {}
        for config in children(self.spark, self.store.path(folder)):
            for month in children(self.spark, config) if f"{_PARTS[0]}=" in config.rpartition("/")[2] else []:
                names = [config.rpartition("/")[2], month.rpartition("/")[2]]
                made["/".join(n.partition("=")[2] for n in names)] = ["/".join([folder, *names])]
        return made

    def _staged(self, rows: DataFrame) -> DataFrame:
        """The incoming rows as written, so that all steps of a merge see the same ones."""
        path = self._step()
        rows.write.parquet(path)
        return self.spark.read.schema(ARCHIVAL_FILE).parquet(path)

    def _numbered(self, files: DataFrame, last: int) -> tuple[DataFrame, int]:
        """One row per file, those without an id numbered after ``last`` by date, configuration and path; and the last number.

        The rows are written in that order over as many tasks as they take, known files first. A row's number follows
        from its place in its file and the rows of the files before, so however many files have one date, or none, no
        task numbers them all.
        """
        order = [F.col("id").isNull(), F.col("as_of_date"), F.col(CONFIG), F.col("blob_path")]
        path = self._step()
        files.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        name = F.col("_metadata.file_name").alias("_name")
        rows = self.spark.read.schema(ARCHIVAL_FILE).parquet(path)
        # One row per written file from here on.
        sizes = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.count("id").alias("_known")).withColumn(
            "_task", F.regexp_extract("_name", r"part-(\d+)", 1).cast("int"))
        before = Window.orderBy("_task", "_name").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_name", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        total, known = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_known"), F.lit(0))).first()
        place = F.col("_start") + F.col("_place") + F.lit(last - known + 1)
        placed = rows.select("*", name, F.col("_metadata.row_index").alias("_place")).join(F.broadcast(starts), "_name")
        return placed.withColumn("id", F.coalesce("id", place)).drop("_name", "_place", "_start"), last + total - known

    def _step(self) -> str:
        return self.store.path(f"steps/{self.store.new_folder()}")

    def clean(self) -> None:
        """Drop what merges have written on their way."""
        remove(self.spark, self.store.path("steps"))
