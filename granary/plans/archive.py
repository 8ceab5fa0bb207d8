"""Archival of one table: retention, export, manifest, deletion, run log.

A run can be broken off anywhere and started again with its number. Its phases leave marks: decisions are written once,
a date is exported once its folder is published, positions to delete are fixed once they are marked, deleted dates
are noted in the run's journal, and the header closes the run. Each step looks for the mark before it does the work, so a second
start goes on where the first one ended and leaves the same rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators import archive as ops
from granary.operators import retention
from granary.operators.retention import CONFIG
from granary.schemas import DELETE_COUNTS, ROWS_PER_PART, RUN, local_table
from granary.sinks.file_table import FileTable
from granary.sinks.positions import mark_deleted, merge_deletes, read_live, with_place
from granary.sinks.publish import children, path_exists, publish_new, publish_swap, remove
from granary.sinks.writers import (
    delete_as_of, log_run_details, partition_date, read_part_files, write_parts,
)


@dataclass(frozen=True)
class ArchiveRun:
    """Where one run puts its output."""

    decisions: str
    data: str
    manifest: str
    deletions: str
    details: str
    files: str
    header: str
    days: str
    journal: str


def run_paths(out: str, run_id: int) -> ArchiveRun:
    names = ("decisions", "data", "manifest", "deletions", "details", "files", "header", "days", "journal")
    return ArchiveRun(*[f"{out.rstrip('/')}/{name}/run_id={run_id}" for name in names])


def read_archived(spark: SparkSession, run: ArchiveRun, schema: T.StructType) -> DataFrame:
    """Exported rows of a source with ``schema``, with their ``archive_date``; none if no date was due or all had been archived."""
    return spark.read.schema(T.StructType([*schema, T.StructField("archive_date", T.DateType())])).parquet(run.data)


class Journal:
    """Dates that a phase of a run has finished, in entries that appear whole or not at all."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def mark(self, phase: str, dates: DataFrame) -> None:
        entry = f"{self.path}/phase={phase}/entry={uuid.uuid4().hex}"
        publish_new(self.spark, entry, lambda staged: dates.select("as_of_date").coalesce(1).write.parquet(staged))

    def dates(self, phase: str) -> DataFrame:
        entries = [c for c in children(self.spark, f"{self.path}/phase={phase}") if "entry=" in c]
        if not entries:
            return self.spark.createDataFrame([], "as_of_date date")
        return self.spark.read.schema("as_of_date date").parquet(*entries).distinct()


def _once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that the first start of a run writes and later ones read."""
    if not path_exists(spark, path):
        rows = make()
        publish_new(spark, path, lambda staged: rows.write.parquet(staged))
    return spark.read.parquet(path)


def _again(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """A table that each start of a run writes anew."""
    publish_swap(spark, path, lambda staged: rows.write.parquet(staged))
    return spark.read.parquet(path)


def _sweep(spark: SparkSession, run: ArchiveRun) -> None:
    """Remove what a start that was broken off had not published."""
    for path in vars(run).values():
        parent, _, name = path.rpartition("/")
        for folder in [*children(spark, parent), *children(spark, path)]:
            own = folder.rpartition("/")[2]
            if own.startswith((f"_staged_{name}_", "_staged_piece=")):
                remove(spark, folder)


def archive_table(
    spark: SparkSession, source: str, as_of_column: str, config_id: int,
    configs: DataFrame, retention_policies: DataFrame, lifecycle_policies: DataFrame,
    files: DataFrame | FileTable, exemptions: DataFrame, out: str, run_id: int, run_ts: dt.datetime,
    rows_per_part: int = ROWS_PER_PART, partitioned: bool = False, merge: bool = True,
) -> ArchiveRun:
    """Archive all due dates of a Parquet table in one export.

    Decisions, manifest and deletion counts are written tables, so no later step computes
    them again from a source that has changed. ``partitioned`` says that the source is
    laid out by ``as_of_column``; its partitions are then dropped, not rewritten. In another source rows are marked as deleted
    and, unless ``merge`` is false, the marks merged into its files. If the export
    fails, it is tried again in halves, so that only the dates at fault are left out and logged
    as failed. The new parts are merged into ``files``: a table of files in place, other rows as the run's own
    file table, for the next run. A run that has ended well is not done again; one that has failed or was broken off goes on.
    """
    one = configs.where(F.col("id") == config_id)
    if one.isEmpty():
        raise ValueError(f"no table configuration {config_id}")
    rows = spark.read.parquet(source)
    if as_of_column not in rows.columns:
        raise ValueError(f"{source} has no column {as_of_column}")
    run = run_paths(out, run_id)
    _sweep(spark, run)
    if path_exists(spark, run.header):
        if spark.read.schema(RUN).parquet(run.header).first()["status"] == "Success":
            return run
        remove(spark, run.header)
    remove(spark, run.details)
    known = files.read() if isinstance(files, FileTable) else files

    # One pass over the column serves the dates, the decisions and the writer.
    day = F.to_date(F.col(as_of_column)).alias("as_of_date")
    days = _once(spark, run.days, lambda: rows.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows")).where("as_of_date is not null"))
    dates = days.select("as_of_date", F.lit(config_id).alias(CONFIG))
    candidates = retention.candidate_dates(retention.date_types(dates), one, retention_policies)
    decisions = _once(spark, run.decisions, lambda: retention.archive_decisions(candidates, one, known, exemptions))

    fresh = not path_exists(spark, run.data)
    try:
        manifest, bad = _export(
            spark, rows, as_of_column, days, decisions, one, lifecycle_policies, exemptions,
            run, run_ts, rows_per_part,
        )
    except Exception as error:
        if fresh:  # what an earlier start has published may be all that is left of its dates
            remove(spark, run.data)
            remove(spark, run.manifest)
        log_run_details(ops.failed_details(decisions, run_id, "Export", str(error)), run.details)
        _log_header(spark, run, run_id, run_ts, "Failed", str(error))
        raise
    if isinstance(files, FileTable):
        files.merge(manifest)
    else:
        _again(spark, run.files, ops.merge_manifest(files, manifest))
    not_exported = [ops.failed_details(decisions.where(F.col("as_of_date") == day), run_id, "Export", why) for day, why in bad.items()]
    decisions = decisions.where(~F.col("as_of_date").isin(*bad)) if bad else decisions

    exported = manifest.groupBy(CONFIG, "as_of_date").agg(
        F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("part_count"),
        F.max("template_path").alias("file_path"),
    )
    counts = local_table(spark, [], DELETE_COUNTS)
    failed = None
    if one.select("delete_from_source").first()[0]:
        try:
            counts = _delete(spark, source, rows, as_of_column, exported, run, run_id, partitioned, merge)
        except Exception as error:
            # The export stands; the failed deletion is only recorded.
            failed = ops.failed_details(decisions, run_id, "Delete", str(error))
    details = ops.run_details(decisions, exported, ops.delete_reconcile(counts), run_id)
    for more in [failed, *not_exported]:
        details = details if more is None else details.unionByName(more)
    log_run_details(details, run.details)
    _log_header(spark, run, run_id, run_ts, "Failed" if failed is not None or bad else "Success", None)
    return run


def _log_header(spark, run: ArchiveRun, run_id: int, run_ts: dt.datetime, status: str, note: str | None) -> None:
    ended = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    header = local_table(spark, [(run_id, run_ts, ended, status, note)], RUN)
    publish_new(spark, run.header, lambda staged: header.write.parquet(staged))


def _exported_dates(spark, path: str) -> set[dt.date]:
    """Dates whose folders are published, directly or in pieces; a few thousand at most."""
    found: set[dt.date] = set()
    for folder in children(spark, path):
        name = folder.rpartition("/")[2]
        if name.startswith("piece="):
            found |= _exported_dates(spark, folder)
        elif day := partition_date(name, "archive_date"):
            found.add(day)
    return found


def _export(
    spark, rows, as_of_column, days, decisions, one, lifecycle_policies, exemptions,
    run: ArchiveRun, run_ts, rows_per_part,
) -> tuple[DataFrame, dict[dt.date, str]]:
    """Write the parts of all planned dates not exported yet, then the manifest read back from the files.

    Also returns the dates that could not be written, with the reason.
    """
    planned = decisions.where("decision = 'Export'")
    day = F.to_date(F.col(as_of_column))

    def write(plan: DataFrame, path: str) -> None:
        first, last = plan.agg(F.min("as_of_date"), F.max("as_of_date")).first()
        in_range = day.between(F.lit(first), F.lit(last)) if first else F.lit(False)
        due = ops.on_planned_dates(ops.with_position(rows.where(in_range)), as_of_column, plan)
        counts = plan.join(days, "as_of_date").select(F.col("as_of_date").alias("archive_date"), "n_rows")
        write_parts(due, path, ops.position_slice(), rows_per_part, counts=counts)

    bad: dict[dt.date, str] = {}
    started = path_exists(spark, run.data)
    # One row per date: a few thousand at most.
    due = sorted(r[0] for r in planned.select("as_of_date").distinct().toLocalIterator())
    there = _exported_dates(spark, run.data)
    left = [d for d in due if d not in there]
    if left or not started:
        plan = planned.where(F.col("as_of_date").isin(*left)) if started else planned
        path = f"{run.data}/piece={uuid.uuid4().hex}" if started else run.data
        try:
            write(plan, path)
        except Exception as error:
            remove(spark, path)
            _export_halves(spark, plan, left, write, run.data, bad)
            if len(bad) == len(due):
                raise error
    parts = read_part_files(spark, run.data).join(
        planned.select(CONFIG, "as_of_date", "date_type"), "as_of_date"
    )
    if left or not path_exists(spark, run.manifest):
        made = ops.manifest(parts, one, lifecycle_policies, exemptions, run_ts)
        # The recorded path is that of the file; the one the template spells comes along.
        _again(spark, run.manifest, made.withColumn("template_path", F.col("blob_path")).withColumn("blob_path", F.col("data_file")))
        Journal(spark, run.journal).mark("export", planned.where(F.col("as_of_date").isin(*left)))
    return spark.read.parquet(run.manifest), bad


def _export_halves(spark, planned, days, write, path, bad: dict[dt.date, str]) -> None:
    """Export dates in ever smaller groups until the ones that fail stand alone."""
    middle = len(days) // 2
    for half in (days[:middle], days[middle:]):
        if not half:
            continue
        piece = f"{path}/piece={half[0].isoformat()}"
        try:
            write(planned.where(F.col("as_of_date").isin(*half)), piece)
        except Exception as error:
            remove(spark, piece)
            if len(half) == 1:
                bad[half[0]] = str(error)
            else:
                _export_halves(spark, planned, half, write, path, bad)


def _delete(
    spark, source, rows, as_of_column, exported, run: ArchiveRun, run_id: int, partitioned: bool, merge: bool
) -> DataFrame:
    """Delete the dates whose written parts hold exactly their source rows.

    Returns expected and deleted rows per date; a date with a difference is left alone. What
    was deleted is counted in the source afterwards, not taken from the plan. Dates that an earlier start has dealt
    with are not deleted again, so rows that came for them since then stay.
    """
    journal = Journal(spark, run.journal)
    day = F.to_date(F.col(as_of_column))
    # Marks say themselves which dates they are for, in case the journal was not written any more.
    marks = [c for c in children(spark, f"{source.rstrip('/')}/_deletes") if c.rpartition("/")[2].startswith(f"run_id={run_id}-")]
    done = journal.dates("delete")
    if marks:
        done = done.union(spark.read.schema("as_of_date date").parquet(*marks)).distinct()

    def now() -> DataFrame:
        return read_live(spark, source, rows.schema)

    # Counted anew for the dates to drop: rows that arrived meanwhile were not exported.
    due = exported.join(done, "as_of_date", "left_anti").select(F.col("as_of_date").alias("_due"))
    held = now().join(due, day == F.col("_due"), "left_semi").groupBy(day.alias("as_of_date")).agg(F.count(F.lit(1)).alias("held"))
    before = f"{run.deletions}_plan"
    more = exported.join(held, "as_of_date").select(CONFIG, "as_of_date", F.col("row_count").alias("expected_rows"), "held")
    start = len([c for c in children(spark, before) if "start=" in c])
    publish_new(spark, f"{before}/start={start}", lambda staged: more.write.parquet(staged))
    # A date's newest count holds; dates that an earlier start has dealt with are not counted again.
    planned = spark.read.schema(f"{CONFIG} int, as_of_date date, expected_rows long, held long, start int").parquet(before).groupBy(
        CONFIG, "as_of_date").agg(*[F.max_by(c, "start").alias(c) for c in ("expected_rows", "held")])
    gone = planned.where("held = expected_rows").join(done, "as_of_date", "left_anti").select(F.col("as_of_date").alias("_gone"))
    if partitioned:
        # One row per date: a few thousand at most.
        delete_as_of(spark, source, as_of_column, [r[0] for r in gone.toLocalIterator()])
    elif not gone.isEmpty():
        hit = with_place(spark.read.schema(rows.schema).parquet(source)).join(gone, day == F.col("_gone"), "left_semi")
        mark_deleted(hit.withColumn("as_of_date", day), source, f"run_id={run_id}-{uuid.uuid4().hex}", ["as_of_date"])
    journal.mark("delete", planned.where("held = expected_rows").join(journal.dates("delete"), "as_of_date", "left_anti"))
    if merge and not partitioned:
        merge_deletes(spark, source)
    left = now().join(planned.where("held = expected_rows").select(F.col("as_of_date").alias("_gone")), day == F.col("_gone"), "left_semi")
    still = left.groupBy(day.alias("as_of_date")).agg(F.count(F.lit(1)).alias("left"))
    removed = F.when(F.col("held") == F.col("expected_rows"), F.col("held") - F.coalesce("left", F.lit(0))).otherwise(0)
    return _again(spark, run.deletions, planned.join(still, "as_of_date", "left").select(
        CONFIG, "as_of_date", "expected_rows", removed.alias("actual_rows")))

