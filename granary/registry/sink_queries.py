"""Registered queries that write, and read back what they wrote.

Each run takes a new folder below the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas
from granary.functions.dates import local_to_utc, stamp
from granary.operators import archive, documents, retention
from granary.plans.archive import archive_table
from granary.plans.ingest import import_snapshot, ingest_feed, load_provider_deals, staged_rejects, staged_rows
from granary.plans.lifecycle import enforce_lifecycle
from granary.plans.profile import profile_catalog
from granary.registry import fixtures as fx
from granary.registry.queries import query
from granary.session import shared_dir
from granary.sinks import writers
from granary.sinks.publish import children, move
from granary.sinks.snapshots import Snapshots
from granary.sources.files import (
    scan_json_array, scan_objects, scan_record_lines, scan_untyped,
)
from granary.sources.tables import scan_table
from granary.streaming.discovery import stream_discovery
from granary.streaming.feeds import stream_feed


def _exported(spark, sf) -> str:
    """Orders exported by year, at most 2,000 rows to a part."""
    out = shared_dir(spark, "parts")
    year = F.to_date(F.trunc("o_orderdate", "year")).alias("archive_date")
    rows = archive.with_position(fx.table(spark, sf, "orders")).select("*", year)
    return writers.write_parts(rows, out, archive.position_slice(), rows_per_part=2000)


@query
def write_parts(spark, sf):
    """Sizes of the exported parts."""
    return writers.read_part_files(spark, _exported(spark, sf)).select(
        "as_of_date", "part_index", "row_count"
    )


@query
def read_parts(spark, sf):
    """The exported rows again, whole."""
    orders = fx.table(spark, sf, "orders")
    return spark.read.parquet(_exported(spark, sf)).select(*orders.columns)


@query
def archive_job(spark, sf):
    """Run details of one archival of orders, dated by month, with deletion."""
    base = shared_dir(spark, "archive")
    source = f"{base}/source"
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, sf, "orders").select("*", month).write.parquet(source)
    run = archive_table(
        spark, source, "as_of_date", 10, schemas.table_configurations(spark),
        schemas.retention_policies(spark), schemas.lifecycle_policies(spark),
        fx.archival_files(spark, sf), fx.exemptions(spark), f"{base}/out", fx.RUN_ID, fx.RUN_TS,
        rows_per_part=1000,
    )
    return spark.read.schema(schemas.RUN_DETAIL).parquet(run.details)


@query
def archive_job_survivors(spark, sf):
    """What the same archival leaves in the source, per month."""
    base = shared_dir(spark, "archive")
    source = f"{base}/source"
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, sf, "orders").select("*", month).write.partitionBy("as_of_date").parquet(source)
    archive_table(
        spark, source, "as_of_date", 10, schemas.table_configurations(spark),
        schemas.retention_policies(spark), schemas.lifecycle_policies(spark),
        fx.archival_files(spark, sf), fx.exemptions(spark), f"{base}/out", fx.RUN_ID, fx.RUN_TS,
        rows_per_part=1000, partitioned=True,
    )
    left = spark.read.parquet(source)
    return left.groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_job(spark, sf):
    """Lines per table after a batch ingest."""
    base = shared_dir(spark, "feed")
    fx.feed(spark, sf).write.text(f"{base}/in")
    return ingest_feed(spark, f"{base}/in", f"{base}/out", f"{base}/tee")


@query
def tee_archive(spark, sf):
    """The gzip copy, read back."""
    out = shared_dir(spark, "tee")
    writers.tee_archive(fx.feed(spark, sf), out)
    return scan_record_lines(spark, out)


@query
def stream_ingest(spark, sf):
    """Lines per table after a streaming ingest of the same feed."""
    base = shared_dir(spark, "stream")
    fx.feed(spark, sf).write.text(f"{base}/in")
    stream_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ck", f"{base}/tee").awaitTermination()
    return writers.routed_counts(spark, f"{base}/out")


@query
def stream_tee(spark, sf):
    """The gzip copy that the streaming ingest keeps."""
    base = shared_dir(spark, "stream")
    fx.feed(spark, sf).write.text(f"{base}/in")
    stream_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ck", f"{base}/tee").awaitTermination()
    return scan_record_lines(spark, f"{base}/tee").select("value")


@query
def stream_batch_hook(spark, sf):
    """Lines that the caller's hook got to see, over all micro-batches of a few files."""
    base = shared_dir(spark, "stream")
    fx.feed(spark, sf).repartition(12, "value").write.text(f"{base}/in")

    def seen(lines, batch):
        lines.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/seen/batch_id={batch}")

    stream_feed(
        spark, f"{base}/in", f"{base}/out", f"{base}/ck", files_per_batch=5, on_batch=seen
    ).awaitTermination()
    batches = spark.read.schema("n long").parquet(f"{base}/seen")
    return batches.agg(F.sum("n").alias("n"), (F.count(F.lit(1)) > 1).alias("several"))


def _dropped_objects(spark, sf) -> str:
    """Objects another job dropped into folders named by their month."""
    base = shared_dir(spark, "objects")
    month = F.date_format("o_orderdate", "yyyy-MM-01").alias("day")
    orders = fx.table(spark, sf, "orders").select(month, F.col("o_orderkey").cast("string").alias("value"))
    orders.repartition("day").write.partitionBy("day").text(f"{base}/in")
    for folder in children(spark, f"{base}/in"):
        if "day=" in folder:
            move(spark, folder, folder.replace("day=", ""))
    return base


@query
def stream_discovery_job(spark, sf):
    """Dropped objects as a stream registers them, and the dates found."""
    base = _dropped_objects(spark, sf)
    stream_discovery(spark, f"{base}/in", 20, f"{base}/out", f"{base}/ck").awaitTermination()
    found = spark.read.schema(schemas.ARCHIVAL_FILE).parquet(f"{base}/out")
    return found.groupBy("table_configuration_id", "as_of_date", "date_type", "status").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("file_size_bytes") > 0).alias("sized")
    )


@query
def object_listing(spark, sf):
    """The same objects as a batch listing."""
    found = scan_objects(spark, _dropped_objects(spark, sf), "in")
    return found.where("as_of_date is not null").groupBy("as_of_date", "date_type").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("file_size_bytes") > 0).alias("sized")
    )


@query
def scan_files(spark, sf):
    """A table read by its place."""
    return scan_table(spark, "parquet", f"{sf}/supplier.parquet")


@query
def scan_catalog(spark, sf):
    """A table read by its name."""
    fx.table(spark, sf, "supplier").createOrReplaceTempView("granary_supplier")
    return scan_table(spark, "catalog", table="granary_supplier")


@query
def json_array_files(spark, sf):
    """Parts of a brand as JSON arrays of at most 100 objects, one to a file, read back."""
    base = f"{shared_dir(spark, 'json')}/arrays"
    part = fx.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    writers.write_json_arrays(part, base, ["p_brand"], "p_partkey", 100)
    schema = T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType()),
    ])
    return scan_json_array(spark, base, schema)


@query
def json_file(spark, sf):
    """A table as JSON with its nulls written out."""
    path = shared_dir(spark, "json")
    some = fx.table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    writers.write_json(some, path)
    return spark.read.text(path)


@query
def tsv_report(spark, sf):
    """A report as tab-separated text, read back."""
    path = shared_dir(spark, "report")
    nation = fx.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.write_report_tsv(nation, path)
    return spark.read.schema(nation.schema).option("sep", "\t").option("header", True).csv(path)


@query
def empty_part(spark, sf):
    """What an export without rows leaves: one file with the table's columns."""
    out = shared_dir(spark, "parts")
    none = fx.table(spark, sf, "orders").where("o_orderkey < 0")
    rows = archive.with_position(none).select("*", F.to_date("o_orderdate").alias("archive_date"))
    writers.write_parts(rows, out, archive.position_slice(), empty_part=True)
    left = spark.read.parquet(out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(out)
    return files.agg(F.count(F.lit(1)).alias("files")).select(
        "files", F.lit(",".join(left.columns)).alias("columns"), F.lit(left.count()).cast("long").alias("rows"))


@query
def archived_inputs(spark, sf):
    """Rows in the inputs of an enrichment job after they were moved to the archive."""
    base = shared_dir(spark, "inputs")
    a = fx.file_a(spark, sf)
    a.write.option("header", True).csv(f"{base}/a")
    fx.table(spark, sf, "nation").write.option("header", True).csv(f"{base}/b")
    moved = writers.archive_inputs(spark, {"FileA": f"{base}/a", "FileB": f"{base}/b"}, base, fx.RUN_TS)
    parts = [
        spark.read.option("header", True).csv(path).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(path.rpartition("/")[2]).alias("name"), "n") for path in moved
    ]
    return parts[0].unionByName(parts[1])


@query
def file_stamps(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", stamp(F.col("ts")).alias("stamp"))


@query
def default_date_type(spark, sf):
    """Ship dates with the types found for order dates; a date without one counts as end of day."""
    config = F.lit(10).alias(retention.CONFIG)
    dates = [retention.as_of_dates(fx.table(spark, sf, t), c).withColumn(retention.CONFIG, config)
             for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))]
    types = retention.date_types(dates[1]).where("date_type <> 'EOD'")
    return retention.typed_candidates(dates[0], types).select(retention.CONFIG, "as_of_date", "date_type")


@query
def json_shape_nested(spark, sf):
    """Shape of objects three levels deep."""
    inner = F.struct(F.col("o_totalprice").alias("total"), F.struct(F.col("o_orderstatus").alias("status")).alias("state"))
    nested = F.to_json(F.struct(F.col("o_orderkey").alias("key"), inner.alias("order")))
    return documents.json_shape(fx.table(spark, sf, "orders").select(nested.alias("j")), "j")


@query
def catalog_profile(spark, sf):
    """Columns that a profile of two tables finds to hold 0 and 1, and the sizes of its other parts."""
    found = profile_catalog(fx.tables(spark, sf, "labels", "orders"), ("int", "bigint"), "labels,orders")
    return found.binary.withColumn("listed", F.lit(found.columns.count())).withColumn("mapped", F.lit(found.type_map.count()))


@query
def repeated_hour(spark, sf):
    """Order days at a quarter to two on the night clocks are set back by half an hour."""
    local = F.expr("make_timestamp_ntz(2024, 4, 7, 1, 30 + cast(o_orderkey % 30 as int), 0)")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", local_to_utc(local, "Australia/Lord_Howe").alias("utc"))


@query
def provider_deals_job(spark, sf):
    """The enrichment job from CSV files to the published run."""
    base = shared_dir(spark, "deals")
    rename_a = dict(zip(fx.file_a(spark, sf).columns, schemas.FILE_A.names))
    a = fx.file_a(spark, sf).withColumnsRenamed(rename_a)
    a.write.option("header", True).csv(f"{base}/a")
    b = fx.file_b(spark, sf).orderBy("seq").select(
        F.col("trade_id").alias("TradeId"), F.col("category").alias("Category"),
        F.col("indicator_type").alias("IndicatorType"),
        F.col("indicator_sub_type").alias("IndicatorSubTypeCode"),
        F.col("measure_value").alias("MeasureValue"),
    )
    b.write.option("header", True).csv(f"{base}/b")
    load_provider_deals(
        spark, f"{base}/a", f"{base}/b", f"{base}/out", fx.RUN_TS, fx.RUN_ID,
        archive_root=base,
    )
    return spark.read.parquet(f"{base}/out").drop("run_id")


_FUNDS = {"FundId": "fund_id", "Month": "month", "Year": "year", "Return": "return"}


def _staged(spark, sf) -> Snapshots:
    """All template rows loaded three times, replaced by the second load and appended to by the third."""
    store = Snapshots(spark, shared_dir(spark, "staging"))
    rows, rules = fx.template_rows(spark, sf), [("return_positive", "`return` > 0")]
    for truncate in (True, True, False):
        import_snapshot(rows, schemas.template("Template1"), store, rules, _FUNDS, truncate)
    return store


@query
def staging_job(spark, sf):
    """A staging table loaded twice: replaced the first time, appended to the second."""
    loaded = staged_rows(_staged(spark, sf), schemas.template("Template1"), _FUNDS)
    return loaded.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fund_id").alias("fund_id_sum")
    )


@query
def staging_rejects(spark, sf):
    """Rows of the same import that do not convert, with the names of their bad cells."""
    return staged_rejects(_staged(spark, sf), schemas.template("Template1"), _FUNDS)


@query
def rollback_job(spark, sf):
    """Two runs of one day, the second taken back."""
    out = shared_dir(spark, "runs")
    rows = fx.file_a(spark, sf)
    writers.append_run(rows, out, fx.RUN_DATE, 1)
    writers.append_run(rows, out, fx.RUN_DATE, 2)
    writers.rollback_run(spark, out, fx.RUN_DATE, 2)
    left = spark.read.parquet(out)
    return left.groupBy("created_on", F.col("run_id").cast("long").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def lifecycle_job(spark, sf):
    """The published action table of one enforcement run."""
    actions, _ = enforce_lifecycle(
        fx.archival_files(spark, sf), schemas.table_configurations(spark),
        schemas.lifecycle_policies(spark), fx.RUN_TS, "devstore", shared_dir(spark, "actions"),
    )
    return actions


@query
def untyped_sheets(spark, sf):
    """A named sheet of text cells."""
    base = shared_dir(spark, "sheets")
    rows = fx.template_rows(spark, sf)
    rows.write.option("header", True).option("emptyValue", "").csv(f"{base}/funds")
    sheet = scan_untyped(spark, base, "funds")
    return sheet.groupBy("FundId").agg(F.count(F.lit(1)).alias("n"), F.count("Return").alias("returns"))
