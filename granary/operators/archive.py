"""Export parts, manifest, run details, and deletion from the source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.dates import wall_clock
from granary.functions.paths import expand_template, file_tags, part_path
from granary.operators.numbering import number_rows
from granary.operators.retention import CONFIG, MSG_EMPTY
from granary.schemas import ARCHIVAL_FILE, ROWS_PER_PART, RUN_DETAIL


def on_date(df: DataFrame, column: str, day: dt.date) -> DataFrame:
    """Rows of one as-of date; reaches the scan as a range on the column."""
    return df.where(F.to_date(F.col(column)) == F.lit(day))


def on_planned_dates(source: DataFrame, column: str, plan: DataFrame) -> DataFrame:
    """Rows of all planned dates at once, with their date as ``archive_date``.

    The plan has one row per date, so it broadcasts below Spark's size limit.
    """
    days = plan.select(F.col("as_of_date").alias("archive_date"))
    return source.withColumn("archive_date", F.to_date(F.col(column))).join(days, "archive_date")


def content_slice(keys: list[str], digits: int = 3) -> tuple[list[Column], Column]:
    """Order and slices for rows that ``keys`` tell apart, spread evenly by digest."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return [digest], F.substring(digest, 1, digits)


def position_slice(rows_per_slice: int = 1_000_000) -> tuple[list[Column], Column]:
    """Order and slices by place in the source files (Parquet scans only).

    Needs no key, so any number of identical rows is spread as well. Take the two
    columns ``source_file`` and ``source_row`` from :func:`with_position`.
    """
    block = F.expr(f"source_row div {rows_per_slice}").alias("block")
    return [F.col("source_file"), F.col("source_row")], F.struct("source_file", block)


def with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.row_index").alias("source_row"),
    )


def assign_parts(
    df: DataFrame, by: tuple[list[Column], Column], rows_per_part: int = ROWS_PER_PART,
    date: str = "as_of_date", hot_rows: int = 1_000_000,
) -> DataFrame:
    """Add the 1-based ``part_index`` per date; each date fills
    ceil(rows / rows_per_part) parts, all full but the last."""
    order, slices = by
    numbered = number_rows(df, [date], order, slices, hot_rows=hot_rows)
    index = F.expr(f"(row_no - 1) div {rows_per_part} + 1").cast("int")
    return numbered.withColumn("part_index", index).drop("row_no")


def part_sizes(rows_per_date: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Parts a date will have, from its row count alone (columns as_of_date, n_rows)."""
    n_parts = F.ceil(F.col("n_rows") / F.lit(rows_per_part)).cast("int")
    size = F.least(
        F.lit(rows_per_part), F.col("n_rows") - (F.col("part_index") - 1) * F.lit(rows_per_part)
    )
    return (
        rows_per_date.where("n_rows > 0")
        .withColumn("part_index", F.explode(F.sequence(F.lit(1), n_parts)))
        .withColumn("row_count", size.cast("long"))
        .drop("n_rows")
    )


def export_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("as_of_date").agg(
        F.count(F.lit(1)).alias("part_count"),
        F.sum("row_count").alias("row_count"),
        F.sum("file_size_bytes").alias("size_bytes"),
    )


def manifest(
    parts: DataFrame, configs: DataFrame, policies: DataFrame, exemptions: DataFrame,
    run_ts: dt.datetime, status: str = "Active",
) -> DataFrame:
    """archival_file rows for parts (config, date, type, index, rows, bytes).

    ``tags`` holds the tag map; ``etag`` and ``data_file`` come along if the parts have
    them. The id is the caller's to assign.
    """
    policy = policies.where("is_active").select(
        F.col("id").alias("file_lifecycle_policy_id"), "azure_policy_tag"
    )
    conf = configs.withColumnRenamed("id", CONFIG).drop("is_active")
    exempt = (
        exemptions.where(F.col("scope") == "File")
        .select(CONFIG, F.col("as_of_date").alias("exempt_date")).distinct()
    )
    whole = exempt.where("exempt_date IS NULL").select(CONFIG, F.lit(True).alias("exempt_table"))
    single = exempt.where("exempt_date IS NOT NULL").select(
        CONFIG, F.col("exempt_date").alias("as_of_date"), F.lit(True).alias("exempt_one")
    )
    base = expand_template(
        F.col("archive_path_template"), F.col("database_name"), F.col("schema_name"),
        F.col("table_name"), F.col("as_of_date"),
    )
    joined = (
        parts.join(conf, CONFIG)
        .join(policy, "file_lifecycle_policy_id", "left")
        .join(whole, CONFIG, "left")
        .join(single, [CONFIG, "as_of_date"], "left")
    )
    is_exempt = F.coalesce("exempt_table", "exempt_one", F.lit(False))
    return joined.select(
        CONFIG, "as_of_date", "date_type", "part_index",
        "storage_account_name", "container_name",
        part_path(base, F.col("part_index")).alias("blob_path"),
        F.lit("application/octet-stream").alias("content_type"),
        "file_size_bytes", "row_count", F.lit(status).alias("status"),
        wall_clock(run_ts).alias("created_at_et"),
        F.col("azure_policy_tag").alias("archival_policy_tag"),
        F.col("file_lifecycle_policy_id").alias("override_file_lifecycle_policy_id"),
        file_tags(
            F.col(CONFIG), F.col("as_of_date"), F.col("date_type"),
            F.col("azure_policy_tag"), is_exempt, F.col("part_index"),
        ).alias("tags"),
        *[c for c in ("etag", "data_file") if c in parts.columns],
    )


def as_archival_files(rows: DataFrame) -> DataFrame:
    """Fit manifest rows to the archival_file schema; unknown columns become null."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ARCHIVAL_FILE
    ])


def merge_manifest(files: DataFrame, made: DataFrame) -> DataFrame:
    """The file table with the parts of a manifest merged in, numbered after its last id."""
    known = as_archival_files(files)
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    # Numbered date by date, so that no task holds all parts of a large manifest.
    order = [F.col("as_of_date"), F.col(CONFIG), F.col("part_index")]
    numbered = number_rows(made.withColumn("_all", F.lit(1)), ["_all"], order, F.col("as_of_date"), "_number")
    return upsert_files(known, as_archival_files(numbered.withColumn("id", last + F.col("_number"))), "created_at_et")


def run_details(
    decisions: DataFrame, exported: DataFrame, deletions: DataFrame, run_id: int
) -> DataFrame:
    """Run-detail rows: skipped dates, exports and deletions, as one table.

    ``exported`` has row_count, part_count and file_path per date; ``deletions`` comes from
    :func:`delete_reconcile`. Dates to export without rows count as skipped.
    """
    key = [CONFIG, "as_of_date"]
    skipped = F.col("decision") == "Skipped"
    base = decisions.join(exported, key, "left")
    rows = F.coalesce("row_count", F.lit(0)).cast("long")
    empty = ~skipped & (rows == 0)
    exports = base.select(
        *key, "date_type", F.lit("Export").alias("phase"),
        F.when(skipped | empty, "Skipped").otherwise("Success").alias("status"),
        F.when(skipped, F.lit(0)).otherwise(rows).cast("long").alias("rows_affected"),
        F.when(~skipped & (F.col("part_count") == 1), F.col("file_path")).alias("file_path"),
        F.when(skipped, F.col("message")).when(empty, MSG_EMPTY).alias("error_message"),
    )
    deletes = deletions.join(decisions.where(~skipped).select(*key, "date_type"), key).select(
        *key, "date_type", F.lit("Delete").alias("phase"), "status",
        F.col("actual_rows").alias("rows_affected"),
        F.lit(None).cast("string").alias("file_path"), "error_message",
    )
    return _as_run_details(exports.unionByName(deletes), run_id)


def failed_details(decisions: DataFrame, run_id: int, phase: str, error: str) -> DataFrame:
    """Run-detail rows of a phase that failed for all dates to export."""
    failed = decisions.where("decision = 'Export'").select(
        CONFIG, "as_of_date", "date_type", F.lit(phase).alias("phase"),
        F.lit("Failed").alias("status"), F.lit(None).alias("rows_affected"),
        F.lit(None).alias("file_path"), F.lit(error).alias("error_message"),
    )
    return _as_run_details(failed, run_id)


def _as_run_details(rows: DataFrame, run_id: int) -> DataFrame:
    out = rows.withColumn("run_id", F.lit(run_id))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_DETAIL])


def upsert_files(existing: DataFrame, incoming: DataFrame, updated: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Newest row per (configuration, date, path); rows merge on the map side, so many
    versions of one file do not pile up in a task. Both inputs share their columns and
    ``updated`` orders the versions; among equal ones an incoming row wins. Columns in ``kept``
    are those of the existing row whichever wins, and null for a file that has none."""
    key = [CONFIG, "as_of_date", "blob_path"]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in key and c not in kept]
    newest = F.max(F.struct(updated, "_new", *[c for c in rest if c != updated]))
    old = [F.max(F.when(F.col("_new") == 0, F.col(c))).alias(c) for c in kept]
    merged = both.groupBy(*key).agg(newest.alias("_row"), *old)
    return merged.select(*[F.col(c) if c in key or c in kept else F.col(f"_row.{c}").alias(c) for c in existing.columns])


def survivors(df: DataFrame, column: str, day: dt.date) -> DataFrame:
    """What a delete of one as-of date leaves; rows without a date always stay."""
    d = F.to_date(F.col(column))
    return df.where(d.isNull() | (d != F.lit(day)))


def delete_reconcile(counts: DataFrame) -> DataFrame:
    """Compare expected and actual deletions; a difference is a warning on a Success row."""
    # Fixed value: the wording of the warning.
    mismatch = (F.col("expected_rows") > 0) & (F.col("expected_rows") != F.col("actual_rows"))
    text = F.concat(
        F.lit("ExpectedDeleteCount="), F.col("expected_rows").cast("string"),
        F.lit(",ActualDeleted="), F.col("actual_rows").cast("string"),
    )
    return counts.withColumn("status", F.lit("Success")).withColumn(
        "error_message", F.when(mismatch, text)
    )
