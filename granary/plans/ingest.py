"""Feed ingest, deal loading and staging import."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.deals import provider_deals, resolve_measures
from granary.operators.feed import Routes
from granary.operators.quality import (
    ACCEPTED, BAD, RAW, Rules, breaks_rules, check_header, map_columns, sorted_out, sorted_out_schema, typed_rejects, typed_rows,
    validation_counts,
)
from granary.schemas import FEED_ROUTES, FILE_A, FILE_B, local_table
from granary.sinks.publish import publish_together, remove
from granary.sinks.snapshots import Snapshots, Version
from granary.sinks.writers import (
    append_run, archive_inputs, counted_lines, load_staging, rollback_run, tee_archive, write_routed,
)
from granary.sources.files import CORRUPT, scan_record_lines, scan_typed_csv, with_file_order


ROUTED_COUNTS = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("n", T.LongType(), False)])


def ingest_feed(
    spark: SparkSession, path: str, out: str, archive: str | None = None,
    routes: Routes = FEED_ROUTES, empty_as_null: bool = False,
) -> DataFrame:
    """Route a feed into ``out``, keep a gzip copy in ``archive``, return lines per table.

    If either write fails, neither is left behind and the error goes on to the caller. Lines are counted as they are written;
    nothing is read again.
    """
    lines = scan_record_lines(spark, path)
    seen = Observation()
    if archive:
        tee_archive(lines, archive)
    try:
        write_routed(lines, out, routes, empty_as_null, seen)
    except BaseException:
        if archive:
            remove(spark, archive)
        raise
    return local_table(spark, list(counted_lines(seen, routes).items()), ROUTED_COUNTS)


# Columns whose name does not follow from the file's header.
_RENAMED = {"IndicatorSubTypeCode": "indicator_sub_type"}


def _snake(df: DataFrame, schema: T.StructType) -> DataFrame:
    names = {
        f.name: _RENAMED.get(f.name, re.sub("(?<!^)(?=[A-Z])", "_", f.name).lower()) for f in schema
    }
    return df.withColumnsRenamed(names)


def load_provider_deals(
    spark: SparkSession, file_a: str, file_b: str, out: str, run_ts: dt.datetime, run_id: int,
    filtered: bool = True, archive_root: str | None = None, rejects: str | None = None,
) -> str:
    """Enrich file A with the measures of file B and publish the rows as one run.

    With ``archive_root`` the inputs move to its archive folder afterwards. A failure takes
    back this run only and is raised again. A row that cannot be read fails the run; with ``rejects`` such rows of both files go
    there instead, as ``record`` with their ``file`` and the ``fields`` that could be read, under the same run.
    """
    read = {label: scan_typed_csv(spark, path, schema, "PERMISSIVE" if rejects else "FAILFAST")
            for label, path, schema in (("FileA", file_a, FILE_A), ("FileB", file_b, FILE_B))}
    good = {label: df.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if rejects else df for label, df in read.items()}
    a = _snake(good["FileA"], FILE_A)
    b = _snake(with_file_order(good["FileB"]), FILE_B)
    day = run_ts.date()
    rows = provider_deals(a, resolve_measures(b, "seq", filtered), day)
    published = append_run(rows, out, day, run_id)
    try:
        if rejects:
            # All fields are asked for: Spark parses only those, and a row is bad for any of them.
            bad = [df.where(F.col(CORRUPT).isNotNull()).select(
                F.lit(label).alias("file"), F.to_json(F.struct(*[c for c in df.columns if c != CORRUPT])).alias("fields"),
                F.col(CORRUPT).alias("record")) for label, df in read.items()]
            append_run(bad[0].unionByName(bad[1]), rejects, day, run_id)
        if archive_root:
            archive_inputs(spark, {"FileA": file_a, "FileB": file_b}, archive_root, run_ts)
    except BaseException:
        rollback_run(spark, out, day, run_id)
        if rejects:
            rollback_run(spark, rejects, day, run_id)
        raise
    return published


def import_staging(
    df: DataFrame, template: T.StructType, path: str, rules: Rules,
    mapping: dict[str, str] | None = None, truncate: bool = True, rejects: str | None = None,
) -> tuple[int, int]:
    """Check, type and load a table; returns its total and rejected rows.

    Without ``rejects`` a cell that does not convert fails the import. With it, rows with such cells
    go to that table, as text and with the names of the cells; they count as total and as rejected.
    """
    check_header(df.columns, template)
    spark = df.sparkSession
    typed = map_columns(typed_rows(df, template, strict=not rejects), mapping)
    if rejects:
        bad = typed_rejects(df, template)
        publish_together(spark, {path: lambda staged: typed.write.parquet(staged), rejects: lambda staged: bad.write.parquet(staged)}, truncate)
    else:
        load_staging(typed, path, truncate)
    row = validation_counts(spark.read.parquet(path), rules).first()
    unread = spark.read.parquet(rejects).count() if rejects else 0
    return row["total_rows"] + unread, row["rejected_rows"] + unread


#: Table of a staging store.
STAGED = "staged"


def import_snapshot(
    df: DataFrame, template: T.StructType, store: Snapshots, rules: Rules,
    mapping: dict[str, str] | None = None, truncate: bool = True,
) -> Version:
    """Check, type and load a table and its rejects as one version of a store.

    One pass reads the input, writes accepted and rejected rows and counts them. The version's values are the
    ``total_rows`` and ``rejected_rows`` of the staging table, those of earlier loads included where this one is appended;
    rows with cells that do not convert, and rows that break a rule, count as rejected. A failed load leaves the newest version as it was.
    """
    check_header(df.columns, template)
    base = store.version()
    kept = base.values if not truncate else {}
    seen = Observation()
    rejected = ~F.col(ACCEPTED) | breaks_rules(rules)
    rows = sorted_out(df, template, mapping).observe(
        seen, F.count(F.lit(1)).alias("total_rows"), F.count_if(rejected).alias("rejected_rows"))
    folder = store.new_folder()
    try:
        rows.write.partitionBy(ACCEPTED).parquet(store.path(folder))
        counts = {k: kept.get(k, 0) + (seen.get.get(k) or 0) for k in ("total_rows", "rejected_rows")}
        earlier = [] if truncate else base.folders.get(STAGED, [])
        return store.commit(base, {STAGED: [*earlier, folder]}, counts)
    except BaseException:
        remove(df.sparkSession, store.path(folder))
        raise


def staged_rows(store: Snapshots, template: T.StructType, mapping: dict[str, str] | None = None, version: int | None = None) -> DataFrame:
    """Accepted rows of a staging store, in its newest version or an earlier one."""
    return store.read(STAGED, sorted_out_schema(template, mapping), version).where(ACCEPTED).drop(RAW, BAD, ACCEPTED)


def staged_rejects(store: Snapshots, template: T.StructType, mapping: dict[str, str] | None = None, version: int | None = None) -> DataFrame:
    """Rejected rows as they were read, with the names of their bad cells."""
    rows = store.read(STAGED, sorted_out_schema(template, mapping), version).where(~F.col(ACCEPTED))
    return rows.select(f"{RAW}.*", F.col(BAD).alias("bad_columns"))
