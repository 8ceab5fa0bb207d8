"""Registered queries over versions: resumed runs, merged tables, snapshots, marked rows, changed objects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas
from granary.operators import retention
from granary.operators.retention import CONFIG
from granary.plans import archive as archive_plan
from granary.plans.ingest import import_snapshot, load_provider_deals, staged_rejects, staged_rows
from granary.registry import fixtures as fx
from granary.registry.queries import query
from granary.session import shared_dir
from granary.sinks import positions, writers
from granary.sinks.file_table import FileTable
from granary.sinks.publish import children, move, path_exists, remove
from granary.sinks.snapshots import Snapshots
from granary.sources.files import scan_json_lines_array
from granary.streaming.discovery import refresh_files


class _BrokenOff(BaseException):
    """Ends a run as a lost driver would: no handler of the job sees it."""


class _Breaking(FileTable):
    """A file table whose first merge ends the run."""

    def merge(self, rows, *args, **kw):
        raise _BrokenOff


def _resumed(spark: SparkSession, sf: str) -> tuple[str, archive_plan.ArchiveRun]:
    """Documents archived by day. The run is broken off once its parts are exported, and started again with its number."""
    base = shared_dir(spark, "archive")
    source = f"{base}/source"
    fx.dated_documents(spark, sf).write.parquet(source)
    files = FileTable(spark, f"{base}/files")
    files.merge(fx.archival_files(spark, sf))

    def start(table: FileTable) -> archive_plan.ArchiveRun:
        return archive_plan.archive_table(
            spark, source, "as_of_date", 10, schemas.table_configurations(spark), schemas.retention_policies(spark),
            schemas.lifecycle_policies(spark), table, fx.exemptions(spark), f"{base}/out", fx.RUN_ID, fx.RUN_TS, rows_per_part=1000)

    try:
        start(_Breaking(spark, f"{base}/files"))
    except _BrokenOff:
        pass
    return base, start(files)


@query
def archive_resume(spark, sf):
    """Run details of an archival by day that was broken off after its export and started again."""
    return spark.read.schema(schemas.RUN_DETAIL).parquet(_resumed(spark, sf)[1].details)


@query
def archive_resume_rows(spark, sf):
    """Where the documents are after the same run: moved once, or left."""
    base, run = _resumed(spark, sf)
    source = spark.read.parquet(f"{base}/source")
    moved = archive_plan.read_archived(spark, run, source.schema).select(
        "doc_id", "n_chars", F.col("archive_date").alias("as_of_date"), F.lit("moved").alias("place"))
    left = source.select("doc_id", "n_chars", "as_of_date", F.lit("left").alias("place"))
    return moved.unionByName(left)


@query
def file_table_merge(spark, sf):
    """The table of files after two merges: half of the files, then a third of them with other sizes, some of them known."""
    table = FileTable(spark, shared_dir(spark, "files"))
    files = fx.document_files(spark, sf)
    table.merge(files.where("doc_id % 2 = 0"))
    later = files.where("doc_id % 3 = 0").withColumn("file_size_bytes", F.col("file_size_bytes") + 1)
    table.merge(later.withColumn("created_at_et", F.expr("created_at_et + INTERVAL 1 DAY")))
    return table.read().select("id", CONFIG, "as_of_date", "blob_path", "file_size_bytes", "status", "created_at_et")


#: Cells of a document as a template names and types them.
_CELLS = T.StructType([
    T.StructField("DocId", T.LongType()), T.StructField("Chars", T.IntegerType()), T.StructField("Source", T.StringType()),
])
_NAMES = {"DocId": "doc_id", "Chars": "n_chars", "Source": "source"}


def _loaded(spark: SparkSession, sf: str) -> Snapshots:
    """A staging store: loaded, appended to with the same rows, and taken back to the first load."""
    store = Snapshots(spark, shared_dir(spark, "snapshots"))
    for truncate in (True, False):
        import_snapshot(fx.document_cells(spark, sf), _CELLS, store, [("short", "n_chars < 5000")], _NAMES, truncate)
    store.rollback(1)
    return store


@query
def snapshot_rollback(spark, sf):
    """Accepted rows after the second load was taken back; that load is still there by its number."""
    store = _loaded(spark, sf)
    rows = staged_rows(store, _CELLS, _NAMES).withColumn("copies", F.lit(1))
    return rows.unionByName(staged_rows(store, _CELLS, _NAMES, 2).withColumn("copies", F.lit(2)))


@query
def snapshot_rejects(spark, sf):
    """Rejected rows of the same store, which changed together with the accepted ones."""
    return staged_rejects(_loaded(spark, sf), _CELLS, _NAMES)


@query
def snapshot_counts(spark, sf):
    """Totals that the loads of the store counted while they wrote."""
    store = _loaded(spark, sf)
    made = [(v, *[store.version(v).values[k] for k in ("total_rows", "rejected_rows")]) for v in store.versions()]
    return schemas.local_table(spark, made, T.StructType([
        T.StructField("version", T.IntegerType()), T.StructField("total_rows", T.LongType()), T.StructField("rejected_rows", T.LongType())]))


def _marked(spark: SparkSession, sf: str) -> str:
    """Documents of which two deletions have marked rows, by day and by length."""
    path = shared_dir(spark, "marked")
    fx.dated_documents(spark, sf).write.parquet(path)
    rows = positions.with_place(spark.read.parquet(path))
    positions.mark_deleted(rows.where(F.dayofmonth("as_of_date") <= 10), path, "days")
    positions.mark_deleted(rows.where("n_chars < 500"), path, "short")
    return path


@query
def delete_by_position(spark, sf):
    """What the marks leave; no data file was written again."""
    return positions.read_live(spark, _marked(spark, sf))


@query
def delete_merged(spark, sf):
    """The same rows read plainly, after the marks were merged into the files."""
    path = _marked(spark, sf)
    positions.merge_deletes(spark, path, files_per_pass=4)
    return spark.read.parquet(path)


def _drop_objects(spark: SparkSession, rows: DataFrame, into: str) -> None:
    """Write one object per day, ``into/<day>/ids.txt``, in the place of one that is there."""
    staged = shared_dir(spark, "dropped")
    rows.select(F.date_format("as_of_date", "yyyy-MM-dd").alias("day"), F.col("doc_id").cast("string").alias("value")).repartition(
        "day").write.partitionBy("day").text(staged)
    for folder in children(spark, staged):
        day = folder.rpartition("day=")[2]
        files = [f for f in children(spark, folder) if f.rpartition("/")[2].startswith("part-")] if "day=" in folder else []
        for file in files:
            target = f"{into}/{day}/ids.txt"
            if path_exists(spark, target):
                remove(spark, target)
            move(spark, file, target)


@query
def object_refresh(spark, sf):
    """The table of files after a second look at a folder: one object per day, those of Sundays written again and longer."""
    base = shared_dir(spark, "objects")
    table, rows = FileTable(spark, f"{base}/files"), fx.dated_documents(spark, sf)
    _drop_objects(spark, rows, f"{base}/in")
    refresh_files(spark, f"{base}/in", 20, table)
    again = rows.where(F.dayofweek("as_of_date") == 1)
    _drop_objects(spark, again.unionByName(again), f"{base}/in")
    refresh_files(spark, f"{base}/in", 20, table)
    return table.read().select("id", CONFIG, "as_of_date", "date_type", "status", "file_size_bytes")


@query
def deal_rejects(spark, sf):
    """An enrichment run over files with rows that cannot be read: what it loads and what it puts aside."""
    base = shared_dir(spark, "deals")
    docs = fx.table(spark, sf, "documents")
    day = "date_format(date_add(DATE'2000-01-01', CAST(pmod(doc_id, 300) AS INT)), 'yyyy-MM-dd')"
    docs.selectExpr(
        "concat('D', doc_id) AS DealId", "concat('t', doc_id) AS TradeId", "source AS BookCode", "lang AS Tsip", "'P' AS ProviderId",
        f"CASE WHEN doc_id % 17 = 5 THEN 'soon' ELSE {day} END AS TradeDate", f"{day} AS BusinessDate", f"{day} AS SettlementDate",
        "CASE WHEN doc_id % 19 = 5 THEN 'much' ELSE CAST(n_chars AS STRING) END AS BuyPrice",
    ).write.option("header", True).csv(f"{base}/a")
    docs.selectExpr(
        "concat('T', doc_id) AS TradeId", "'InventoryPosition' AS Category", "'Nominal' AS IndicatorType",
        "'settleDatePosition' AS IndicatorSubTypeCode", "CAST(n_chars AS STRING) AS MeasureValue",
    ).write.option("header", True).csv(f"{base}/b")
    load_provider_deals(spark, f"{base}/a", f"{base}/b", f"{base}/out", dt.datetime(2000, 6, 30), fx.RUN_ID, rejects=f"{base}/rejects")
    loaded = spark.read.parquet(f"{base}/out").select("deal_id", "measure_value", F.lit("loaded").alias("place"))
    aside = spark.read.parquet(f"{base}/rejects").select(
        F.substring_index("record", ",", 1).alias("deal_id"), F.lit(None).cast("string").alias("measure_value"), F.lit("aside").alias("place"))
    return loaded.unionByName(aside)


@query
def json_array_lines(spark, sf):
    """Documents of a source as JSON arrays of bounded size, read back line by line."""
    path = f"{shared_dir(spark, 'json')}/arrays"
    docs = fx.table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    writers.write_json_arrays(docs, path, ["source"], "doc_id", 5000)
    return scan_json_lines_array(spark, path, docs.schema)


@query
def distinct_as_of_folders(spark, sf):
    """The dates of a table laid out by day, from its folders."""
    path = shared_dir(spark, "daily")
    fx.dated_documents(spark, sf).repartition("as_of_date").write.partitionBy("as_of_date").parquet(path)
    return retention.as_of_dates_of_folders(spark, path, "as_of_date")


@query
def tsv_documents(spark, sf):
    """A report with a row per document as tab-separated text, read back."""
    path = shared_dir(spark, "report")
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    writers.write_report_tsv(docs, path)
    return spark.read.schema(docs.schema).option("sep", "\t").option("header", True).csv(path)
