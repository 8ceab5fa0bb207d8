"""Parquet parts, routed feeds, staging tables and reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.archive import assign_parts
from granary.operators.feed import BLANK, UNROUTED, Routes, routed_rows
from granary.operators.numbering import chunk_rows
from granary.schemas import (
    FEED_ROUTES, JDBC_BATCH_ROWS, ROW_GROUP_BYTES, ROW_GROUP_ROWS, ROWS_PER_PART,
)
from granary.sinks.publish import children, move, path_exists, publish_new, publish_swap, remove

# ------------------------------------------------------------------ archive parts


def write_parts(
    df: DataFrame, path: str, by, rows_per_part: int = ROWS_PER_PART, empty_part: bool = False,
    hot_rows: int = 1_000_000, counts: DataFrame | None = None,
) -> str:
    """Snappy Parquet below ``archive_date=``, ceil(rows / rows_per_part) files per date.

    Rows carry their date as ``archive_date``. A date of up to ``hot_rows`` rows goes to one
    task, which starts a new file every ``rows_per_part`` rows: one shuffle in all. Larger
    dates are numbered first and spread part by part over many tasks. ``counts``, rows per
    ``archive_date`` as ``n_rows``, saves counting them again. Row groups end at 8 MiB or 8,192
    rows, so that the writers a task has open stay small. With ``empty_part`` an input without rows
    leaves a single schema-only file.
    """
    spark = df.sparkSession
    day, place = "archive_date", ["source_file", "source_row"]
    if counts is None:
        counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"))
    hot = counts.where(F.col("n_rows") > hot_rows).select(day)
    # At most rows/hot_rows dates, so the list always fits a broadcast.
    small = df.join(F.broadcast(hot), day, "left_anti").withColumn("part_index", F.lit(None).cast("int"))
    large = assign_parts(
        df.join(F.broadcast(hot), day, "left_semi"), by, rows_per_part, day, hot_rows
    )
    spread = small.unionByName(large).repartition(day, "part_index").drop("part_index", *place)

    def write(staged: str) -> None:
        writer = spread.write.option("maxRecordsPerFile", rows_per_part)
        writer = writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        writer.option("compression", "snappy").partitionBy(day).parquet(staged)
        if empty_part and not any(f"{day}=" in c for c in children(spark, staged)):
            empty = spark.createDataFrame([], df.drop(day, *place).schema).coalesce(1)
            empty.write.mode("overwrite").parquet(staged)

    return publish_new(spark, path, write)


def read_part_files(spark: SparkSession, path: str) -> DataFrame:
    """The written parts: date, index, file, bytes, rows; reads no data column."""
    files = spark.read.schema("archive_date date").parquet(path)
    counted = files.groupBy(
        F.col("archive_date").alias("as_of_date"),
        F.col("_metadata.file_path").alias("data_file"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).agg(F.count(F.lit(1)).alias("row_count"))
    # One row per file from here on; full parts come before a date's last, shorter one.
    order = Window.partitionBy("as_of_date").orderBy(F.desc("row_count"), "data_file")
    etag = F.md5(F.concat_ws("|", "data_file", "file_size_bytes", F.unix_micros("modified")))
    return counted.select(
        "as_of_date", F.row_number().over(order).alias("part_index"), "data_file",
        etag.alias("etag"), "file_size_bytes", "row_count",
    )


# -------------------------------------------------------------------------- feeds


def write_routed(
    lines: DataFrame, path: str, routes: Routes = FEED_ROUTES, empty_as_null: bool = False, seen: Observation | None = None
) -> str:
    """All routes of a feed in one pass, one ``table_name=`` partition each.

    Unrouted and blank lines get partitions of their own. ``seen`` counts the lines of each partition as they are
    written, see :func:`counted_lines`; Spark takes a task's counts once, also if it was retried.
    """
    rows = routed_rows(lines, routes, empty_as_null)
    if seen is not None:
        rows = rows.observe(seen, *[F.count_if(F.col("table_name") == t).alias(f"n{i}") for i, t in enumerate(_partitions(routes))])
    return publish_new(
        lines.sparkSession, path, lambda staged: rows.write.partitionBy("table_name").parquet(staged)
    )


def _partitions(routes: Routes) -> list[str]:
    return [UNROUTED, BLANK, *sorted({t for t, _ in routes.values()})]


def counted_lines(seen: Observation, routes: Routes = FEED_ROUTES) -> dict[str, int]:
    """Lines of each partition that :func:`write_routed` has written."""
    counts = seen.get
    return {t: n for i, t in enumerate(_partitions(routes)) if (n := counts.get(f"n{i}"))}


def _routed_schema(routes: Routes) -> T.StructType:
    width = max(w for _, w in routes.values())
    names = [f"col{i + 1}" for i in range(width)] + ["value", "table_name"]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_routed(spark: SparkSession, path: str, table: str, routes: Routes = FEED_ROUTES):
    width = {t: w for t, w in routes.values()}[table]
    rows = spark.read.schema(_routed_schema(routes)).parquet(path)
    return rows.where(F.col("table_name") == table).select(*[f"col{i + 1}" for i in range(width)])


def read_rejected(spark: SparkSession, path: str, routes: Routes = FEED_ROUTES) -> DataFrame:
    rows = spark.read.schema(_routed_schema(routes)).parquet(path)
    return rows.where(F.col("table_name").isin(UNROUTED, BLANK)).select("table_name", "value")


def routed_counts(spark: SparkSession, path: str, routes: Routes = FEED_ROUTES) -> DataFrame:
    rows = spark.read.schema(_routed_schema(routes)).parquet(path)
    return rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


def tee_archive(lines: DataFrame, path: str) -> str:
    """The lines as read, gzip text; nothing is left behind if the write fails."""
    text = lines.select("value")
    return publish_new(
        lines.sparkSession, path, lambda staged: text.write.option("compression", "gzip").text(staged)
    )


# ----------------------------------------------------------------- loads and rollback


def append_batch(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, rows: int = JDBC_BATCH_ROWS, **options: str):
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(rows), **options).mode(
        "append"
    ).save()


def run_partition(path: str, created_on: dt.date, run_id: int) -> str:
    return f"{path.rstrip('/')}/created_on={created_on.isoformat()}/run_id={run_id}"


def append_run(df: DataFrame, path: str, created_on: dt.date, run_id: int) -> str:
    """One run's rows as the partition (created_on, run_id), published whole."""
    data = df.drop("created_on", "run_id")
    return publish_new(
        df.sparkSession, run_partition(path, created_on, run_id),
        lambda staged: data.write.parquet(staged),
    )


def rollback_run(spark: SparkSession, path: str, created_on: dt.date, run_id: int) -> None:
    """Take back one run; other runs of the day stay."""
    remove(spark, run_partition(path, created_on, run_id))


def load_staging(df: DataFrame, path: str, truncate: bool = True) -> str:
    """Replace a staging table, or append to it; a failed load keeps the old rows."""
    spark = df.sparkSession
    if truncate or not path_exists(spark, path):
        return publish_swap(spark, path, lambda staged: df.write.parquet(staged))
    append_batch(df, path)
    return path


def partition_date(name: str, column: str) -> dt.date | None:
    """Date of a partition folder ``column=value``, whatever the value's type is written like."""
    key, _, value = name.partition("=")
    try:
        return dt.date.fromisoformat(unquote(value)[:10]) if key == column else None
    except ValueError:
        return None


def delete_as_of(spark: SparkSession, path: str, column: str, days: Iterable[dt.date]) -> set[dt.date]:
    """Drop whole date partitions of a table partitioned by ``column``; returns the dates dropped.

    Folders are listed and matched by the date they stand for, so a timestamp or text
    partition counts as well. A folder that cannot be deleted is an error.
    """
    wanted, gone = set(days), set()
    for folder in children(spark, path):
        day = partition_date(folder.rstrip("/").rpartition("/")[2], column)
        if day in wanted:
            remove(spark, folder)
            gone.add(day)
    return gone


# ------------------------------------------------------------------ files and reports


def archive_inputs(
    spark: SparkSession, inputs: dict[str, str], target: str, run_ts: dt.datetime
) -> list[str]:
    """Move input files or folders to ``target/archive/<label>_<yyyyMMdd_HHmmss>.csv``.

    A rename: no data passes through the driver. If one move fails, earlier ones are undone.
    """
    stamp = run_ts.strftime("%Y%m%d_%H%M%S")
    moved: list[tuple[str, str]] = []
    try:
        for label, source in inputs.items():
            copy = f"{target.rstrip('/')}/archive/{label}_{stamp}.csv"
            move(spark, source, copy)
            moved.append((source, copy))
    except BaseException:
        for source, copy in moved:
            move(spark, copy, source)
        raise
    return [copy for _, copy in moved]


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_arrays(
    df: DataFrame, path: str, group: list[str], seq: str, objects_per_array: int = 10_000, rows_per_slice: int = 1_000_000
) -> str:
    """Text files that each hold a JSON array of at most ``objects_per_array`` objects of one group, in the order of ``seq``.

    One object to a line. However large a group is, no row and no file holds more; its arrays are in files of their own.
    """
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    rows = chunk_rows(df.select(*group, seq, body.alias("_body")), group, seq, objects_per_array, rows_per_slice)
    lists = rows.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list(F.struct("row_no", "_body"))).alias("_items"))
    value = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda x: x["_body"]), ",\n"), F.lit("]"))
    arrays = lists.select(value.alias("value"))
    return publish_new(df.sparkSession, path, lambda staged: arrays.write.option("maxRecordsPerFile", 1).text(staged))


def write_report_tsv(df: DataFrame, path: str) -> bool:
    """Tab-separated report with a header, only if there are rows."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return True


def log_run_details(details: DataFrame, path: str) -> None:
    """Append a run's detail rows as one batch."""
    append_batch(details, path)
