import datetime as dt
import glob
import gzip
import os

import pytest
from conftest import as_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import schemas
from granary.operators import archive
from granary.operators.retention import CONFIG
from granary.plans.archive import archive_table
from granary.plans.ingest import import_staging, ingest_feed, load_provider_deals
from granary.plans.lifecycle import enforce_lifecycle
from granary.plans.profile import profile_catalog
from granary.registry import fixtures as fx
from granary.sinks import writers
from granary.sinks.publish import move, publish_new, publish_swap
from granary.sources import files as sources
from granary.sources.tables import quoted, scan_as_of, scan_table

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def data_files(path, suffix=".parquet"):
    return [f for f in glob.glob(f"{path}/**/*{suffix}", recursive=True) if "/." not in f]


@pytest.fixture
def uncoalesced(spark):
    """Keep small shuffle partitions apart, so that tests see how rows spread."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def boom(*_, **__):
    raise RuntimeError("injected")


# ------------------------------------------------------------------------------ parts


@pytest.mark.parametrize("n", [0, 1, 10, 11, 20])
def test_parts_are_full_but_the_last(spark, root, n):
    df = spark.range(n).withColumn("archive_date", F.lit(D(2020, 1, 1)))
    writers.write_parts(df, f"{root}/out", archive.content_slice(["id"]), 10, empty_part=True)
    parts = data_files(f"{root}/out")
    assert len(parts) == max(1, -(-n // 10))
    if n == 0:
        empty = spark.read.parquet(f"{root}/out")
        assert empty.columns == ["id"] and empty.count() == 0
    else:
        sizes = as_rows(writers.read_part_files(spark, f"{root}/out").select("part_index", "row_count", "as_of_date"), "part_index")
        assert [s[1] for s in sizes] == [10] * (n // 10) + ([n % 10] if n % 10 else [])
        assert spark.read.parquet(f"{root}/out").select("id").distinct().count() == n


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_identical_rows_of_a_hot_date_spread_by_position(spark, root, hot_rows, uncoalesced):
    spark.range(110).select(F.lit("same").alias("v"), (F.col("id") < 100).alias("hot")).repartition(3).write.parquet(f"{root}/in")
    day = F.when(F.col("hot"), D(2020, 1, 1)).otherwise(D(2020, 1, 2)).alias("archive_date")
    rows = archive.with_position(spark.read.parquet(f"{root}/in")).select("v", "source_file", "source_row", day)
    writers.write_parts(rows, f"{root}/out", archive.position_slice(5), 30, hot_rows=hot_rows)
    parts = writers.read_part_files(spark, f"{root}/out").orderBy("as_of_date", "part_index").collect()
    assert [(r.as_of_date.day, r.part_index, r.row_count) for r in parts] == [(1, 1, 30), (1, 2, 30), (1, 3, 30), (1, 4, 10), (2, 1, 10)]
    assert spark.read.parquet(f"{root}/out").columns == ["v", "archive_date"]
    if hot_rows == 20:
        # The hot date was written by several tasks.
        assert len({os.path.basename(r.data_file)[:10] for r in parts if r.as_of_date.day == 1}) > 1


# ------------------------------------------------------------------------- publishing


def test_failed_writes_leave_nothing(spark, root):
    def half(staged):
        spark.range(3).write.parquet(staged)
        boom()

    with pytest.raises(RuntimeError):
        publish_new(spark, f"{root}/new", half)
    assert os.listdir(root) == []
    spark.range(5).write.parquet(f"{root}/old")
    with pytest.raises(RuntimeError):
        publish_swap(spark, f"{root}/old", half)
    assert os.listdir(root) == ["old"] and spark.read.parquet(f"{root}/old").count() == 5
    with pytest.raises(FileExistsError):
        publish_new(spark, f"{root}/old", lambda s: None)


# ------------------------------------------------------------------------------ feeds


def test_feed_job_routes_and_keeps_a_copy(spark, root):
    fx.feed(spark, SF).write.text(f"{root}/in")
    counts = dict(as_rows(ingest_feed(spark, f"{root}/in", f"{root}/out", f"{root}/tee")))
    total = fx.feed(spark, SF).count()
    assert sum(counts.values()) == total and counts["_blank"] == 5 and counts["_unrouted"] == 5
    product = writers.read_routed(spark, f"{root}/out", "product")
    assert product.columns == [f"col{i}" for i in range(1, 6)] and product.count() == counts["product"]
    assert writers.read_rejected(spark, f"{root}/out").count() == 10
    lines = []
    for name in data_files(f"{root}/tee", ".gz"):
        with gzip.open(name, "rt") as f:
            lines += f.read().splitlines()
    assert sorted(lines) == sorted(r.value for r in fx.feed(spark, SF).collect())


def test_failed_feed_job_leaves_no_output(spark, root, monkeypatch):
    fx.feed(spark, SF).write.text(f"{root}/in")
    monkeypatch.setattr("granary.plans.ingest.write_routed", boom)
    with pytest.raises(RuntimeError):
        ingest_feed(spark, f"{root}/in", f"{root}/out", f"{root}/tee")
    assert os.listdir(root) == ["in"]


# -------------------------------------------------------------------------------- deals

A = "DealId,TradeId,BookCode,Tsip,ProviderId,TradeDate,BusinessDate,SettlementDate,BuyPrice\n"
B = "TradeId,Category,IndicatorType,IndicatorSubTypeCode,MeasureValue\n"


def deal_files(root, day="2024-01-02"):
    with open(f"{root}/a.csv", "w") as f:
        f.write(A + f" d1 ,t1,b,s,p,{day},2024-01-02,2024-01-04,1.50\nd2,,b,s,p,2024-01-02,2024-01-02,2024-01-04,2\n"
                    "d3,T9,b,s,p,2024-01-02,2024-01-02,2024-01-04,3\n")
    with open(f"{root}/b.csv", "w") as f:
        f.write(B + "T1,InventoryPosition,Nominal,settleDatePosition,10\nt1,inventoryposition,nominal,settledateposition,20\n"
                    "t1,InventoryPosition,Nominal,OriginalTradeAmount,30\nt1,Other,Nominal,settleDatePosition,40\n")
    return f"{root}/a.csv", f"{root}/b.csv"


TS = dt.datetime(2024, 1, 5, 6, 7, 8)


def test_deal_job(spark, root):
    a, b = deal_files(root)
    load_provider_deals(spark, a, b, f"{root}/out", TS, 1, archive_root=root)
    got = {r.deal_id: r for r in spark.read.parquet(f"{root}/out").collect()}
    assert set(got) == {"d1", "d3"} and got["d1"].measure_value == "20" and got["d3"].measure_value is None
    assert str(got["d1"].buy_price) == "1.50" and got["d1"].created_on == TS.date()
    assert sorted(f for f in os.listdir(f"{root}/archive") if not f.startswith(".")) == [
        "FileA_20240105_060708.csv", "FileB_20240105_060708.csv"]


def test_bad_field_fails_the_run(spark, root):
    a, b = deal_files(root, day="not a date")
    with pytest.raises(Exception, match="MALFORMED|PARSE|parse"):
        load_provider_deals(spark, a, b, f"{root}/out", TS, 1)
    assert not data_files(root)


def test_failure_takes_back_this_run_only(spark, root, monkeypatch):
    a, b = deal_files(root)
    load_provider_deals(spark, a, b, f"{root}/out", TS, 1)
    monkeypatch.setattr("granary.plans.ingest.archive_inputs", boom)
    with pytest.raises(RuntimeError):
        load_provider_deals(spark, a, b, f"{root}/out", TS, 2, archive_root=root)
    assert [r[0] for r in spark.read.parquet(f"{root}/out").select("run_id").distinct().collect()] == [1]


def test_inputs_move_together_or_not_at_all(spark, root):
    a, b = deal_files(root)
    with pytest.raises(Exception):
        writers.archive_inputs(spark, {"FileA": a, "FileB": f"{root}/none.csv"}, root, TS)
    assert os.path.exists(a) and not [f for f in os.listdir(f"{root}/archive") if f.endswith(".csv")]
    writers.archive_inputs(spark, {"FileA": a, "FileB": b}, root, TS)
    assert not os.path.exists(a) and not os.path.exists(b)


def test_typed_csv_modes(spark, root):
    a, _ = deal_files(root, day="oops")
    with pytest.raises(Exception):
        sources.scan_typed_csv(spark, a, schemas.FILE_A).collect()
    rows = sources.scan_typed_csv(spark, a, schemas.FILE_A, "PERMISSIVE").collect()
    assert [r.DealId.strip() for r in rows if r[sources.CORRUPT]] == ["d1"] and len(rows) == 3


# ------------------------------------------------------------------------------ staging


def test_staging_replaces_or_appends(spark, root):
    t1 = schemas.TEMPLATES["Template2"]
    df = spark.createDataFrame([("a", "1"), ("b", "-2")], "ColumnA string, ColumnB string")
    rules = [("positive", "b > 0")]
    load = lambda d, truncate: import_staging(d, t1, f"{root}/s", rules, {"ColumnB": "b", "ColumnA": "a"}, truncate)
    assert load(df, True) == (2, 1)
    assert load(df, False) == (4, 2)
    assert load(df, True) == (2, 1)
    bad = df.withColumn("ColumnB", F.lit("x"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load(bad, True)
    assert spark.read.parquet(f"{root}/s").count() == 2
    with pytest.raises(ValueError, match="missing"):
        load(df.drop("ColumnB"), True)


def test_staging_keeps_what_does_not_convert(spark, root):
    df = spark.createDataFrame([("a", "1"), ("b", "-2"), ("c", "x"), ("d", ""), ("e", None)], "ColumnA string, ColumnB string")
    load = lambda truncate: import_staging(
        df, schemas.TEMPLATES["Template2"], f"{root}/s", [("positive", "ColumnB > 0")], None, truncate, f"{root}/r")
    rows = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{root}/{name}").fillna(0).collect())
    for truncate, times in ((True, 1), (False, 2), (True, 1)):
        assert load(truncate) == (5 * times, 4 * times)
        assert rows("s") == sorted([("a", 1), ("b", -2), ("e", 0)] * times)
        assert rows("r") == sorted([("c", "x", "ColumnB"), ("d", "", "ColumnB")] * times)


def test_staging_job_imports_every_row(spark, monkeypatch):
    from granary.registry import sink_queries

    seen, load = [], sink_queries.import_snapshot
    monkeypatch.setattr(sink_queries, "import_snapshot", lambda rows, *a: (seen.append(rows.count()), load(rows, *a))[1])
    sink_queries.staging_job(spark, SF).count()
    assert seen == [fx.table(spark, SF, "lineitem").count()] * 3


# ------------------------------------------------------------------------------ archive


def archive_orders(spark, root, run_id, partitioned=False, source=None, **kw):
    args = dict(
        source=source or f"{root}/src", as_of_column="as_of_date", config_id=10,
        configs=schemas.table_configurations(spark), retention_policies=schemas.retention_policies(spark),
        lifecycle_policies=schemas.lifecycle_policies(spark), files=fx.archival_files(spark, SF).limit(0),
        exemptions=fx.exemptions(spark), out=f"{root}/out", run_id=run_id, run_ts=TS, rows_per_part=10,
        partitioned=partitioned,
    )
    return archive_table(spark, **(args | kw))


@pytest.mark.parametrize("partitioned", [True, False])
def test_archive_moves_rows_without_loss(spark, root, partitioned):
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    orders = fx.table(spark, SF, "orders").select("*", month)
    with_null = orders.unionByName(orders.limit(3).withColumn("as_of_date", F.lit(None).cast("date")))
    writer = with_null.write.partitionBy("as_of_date") if partitioned else with_null.write
    writer.parquet(f"{root}/src")
    run = archive_orders(spark, root, 1, partitioned)
    columns = fx.table(spark, SF, "orders").columns
    moved, left = spark.read.parquet(run.data).select(columns), spark.read.parquet(f"{root}/src").select(columns)
    assert moved.count() > 0 and left.count() > 0
    both = moved.unionByName(left)
    assert both.count() == with_null.count() and both.exceptAll(with_null.select(columns)).count() == 0
    details = spark.read.parquet(run.details)
    done = details.where("status = 'Success'").groupBy("phase").agg(F.sum("rows_affected").alias("n"))
    assert dict(as_rows(done)) == {"Export": moved.count(), "Delete": moved.count()}
    manifest = spark.read.parquet(run.manifest)
    assert manifest.agg(F.sum("row_count"), F.max("row_count")).first()[0] == moved.count()
    assert manifest.agg(F.max("row_count")).first()[0] <= 10
    # A second run may move more, but nothing is lost or moved twice.
    archive_orders(spark, root, 2, partitioned, files=archive.as_archival_files(manifest))
    moved, left = spark.read.parquet(f"{root}/out/data").select(columns), spark.read.parquet(f"{root}/src").select(columns)
    assert moved.unionByName(left).exceptAll(with_null.select(columns)).count() == 0
    assert moved.count() + left.count() == with_null.count()


def test_archive_drops_timestamp_partitions(spark, root):
    month = F.trunc("o_orderdate", "month").cast("timestamp_ntz").alias("as_of_date")
    orders = fx.table(spark, SF, "orders").select("*", month)
    orders.write.partitionBy("as_of_date").parquet(f"{root}/src")
    run = archive_orders(spark, root, 1, True)
    left = spark.read.parquet(f"{root}/src").count()
    deleted = spark.read.parquet(run.details).where("phase = 'Delete' and status = 'Success'").agg(F.sum("rows_affected")).first()[0]
    assert 0 < deleted == orders.count() - left == spark.read.parquet(run.data).count()


def test_deletions_count_what_is_gone(spark, root, monkeypatch):
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, SF, "orders").select("*", month).write.partitionBy("as_of_date").parquet(f"{root}/src")
    monkeypatch.setattr("granary.plans.archive.delete_as_of", lambda *args: set())
    details = spark.read.parquet(archive_orders(spark, root, 1, True).details)
    deletes = details.where("phase = 'Delete'")
    assert deletes.agg(F.sum("rows_affected")).first()[0] == 0
    assert deletes.where("error_message is null").count() == 0


def test_manifest_names_files_that_exist(spark, root):
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, SF, "orders").select("*", month).write.parquet(f"{root}/src")
    manifest = spark.read.parquet(archive_orders(spark, root, 1).manifest).collect()
    assert manifest and all(os.path.exists(r.blob_path.removeprefix("file:")) for r in manifest)
    assert all(r.template_path.endswith(".parquet") and r.template_path != r.blob_path for r in manifest)


def test_archive_refuses_unknown_names(spark, root):
    spark.range(3).write.parquet(f"{root}/src")
    with pytest.raises(ValueError, match="no table configuration 99"):
        archive_orders(spark, root, 1, config_id=99)
    with pytest.raises(ValueError, match="no column as_of_date"):
        archive_orders(spark, root, 1)
    assert os.listdir(root) == ["src"]


def test_one_bad_date_does_not_stop_the_others(spark, root, monkeypatch):
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, SF, "orders").select("*", month).write.parquet(f"{root}/src")
    bad = D(1995, 3, 1)

    def picky(df, path, *args, **kw):
        if df.where(F.col("archive_date") == F.lit(bad)).count():
            raise RuntimeError("bad date")
        return writers.write_parts(df, path, *args, **kw)

    monkeypatch.setattr("granary.plans.archive.write_parts", picky)
    run = archive_orders(spark, root, 1)
    details = spark.read.parquet(run.details)
    assert [(r.as_of_date, r.error_message) for r in details.where("status = 'Failed'").collect()] == [(bad, "bad date")]
    moved = {r[0] for r in spark.read.parquet(run.data).select("archive_date").distinct().collect()}
    assert len(moved) > 10 and bad not in moved
    assert spark.read.parquet(f"{root}/src").where(F.col("as_of_date") == F.lit(bad)).count() > 0
    assert spark.read.parquet(run.header).select("id", "status").collect() == [(1, "Failed")]


def test_second_run_exports_nothing(spark, root):
    month = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, SF, "orders").select("*", month).write.parquet(f"{root}/src")
    few = schemas.retention_policies(spark).withColumn("keep_last_eom", F.lit(1))
    kw = dict(config_id=30, retention_policies=few, exemptions=fx.exemptions(spark).limit(0))
    first = archive_orders(spark, root, 1, **kw)
    known = spark.read.parquet(first.files)
    assert known.count() == spark.read.parquet(first.manifest).count() == known.select("id").distinct().count() > 0
    second = archive_orders(spark, root, 2, files=known, **kw)
    assert spark.read.parquet(second.decisions).where("decision = 'Export'").count() == 0
    assert spark.read.parquet(second.files).count() == known.count()
    assert spark.read.parquet(second.header).select("status").collect() == [("Success",)]


def test_failed_export_is_logged_and_cleaned(spark, root, monkeypatch):
    fx.table(spark, SF, "orders").select("*", F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")).write.parquet(f"{root}/src")
    before = spark.read.parquet(f"{root}/src").count()
    monkeypatch.setattr("granary.plans.archive.read_part_files", boom)
    with pytest.raises(RuntimeError):
        archive_orders(spark, root, 1)
    details = spark.read.parquet(f"{root}/out/details/run_id=1")
    assert details.select("phase", "status").distinct().collect() == [("Export", "Failed")]
    assert not os.path.exists(f"{root}/out/data/run_id=1") and spark.read.parquet(f"{root}/src").count() == before


def test_failed_deletion_keeps_the_export(spark, root, monkeypatch):
    fx.table(spark, SF, "orders").select("*", F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")).write.parquet(f"{root}/src")
    monkeypatch.setattr("granary.plans.archive.merge_deletes", boom)
    run = archive_orders(spark, root, 1)
    got = set(as_rows(spark.read.parquet(run.details).select("phase", "status").distinct()))
    assert {("Export", "Success"), ("Delete", "Failed")} <= got and ("Delete", "Success") not in got
    assert data_files(run.data)


def test_config_without_delete_keeps_the_source(spark, root):
    day = F.to_date(F.trunc("o_orderdate", "month")).alias("as_of_date")
    fx.table(spark, SF, "orders").select("*", day).write.parquet(f"{root}/src")
    keep_one = schemas.retention_policies(spark).withColumn("keep_last_eom", F.lit(1))
    run = archive_orders(spark, root, 1, config_id=30, retention_policies=keep_one,
                         exemptions=fx.exemptions(spark).limit(0))
    details = spark.read.parquet(run.details)
    assert details.where("phase = 'Delete'").count() == 0 and details.where("status = 'Success'").count() > 0
    assert spark.read.parquet(f"{root}/src").count() == fx.table(spark, SF, "orders").count()


# ------------------------------------------------------------------- lifecycle, profile


def test_lifecycle_dry_run_writes_nothing(spark, root):
    args = (fx.archival_files(spark, SF), schemas.table_configurations(spark), schemas.lifecycle_policies(spark), fx.RUN_TS, "devstore")
    actions, summary = enforce_lifecycle(*args, f"{root}/a", dry_run=True)
    assert os.listdir(root) == [] and summary.agg(F.sum("files")).first()[0] == actions.count()
    published, _ = enforce_lifecycle(*args, f"{root}/a")
    assert published.exceptAll(actions).count() == 0


def test_profile(spark):
    p = profile_catalog(fx.tables(spark, SF, "labels", "events", "orders"), ("int",), "labels,orders")
    assert as_rows(p.binary, "column_name") == [("labels", "quality"), ("labels", "toxic")]
    assert p.columns.count() == 2 and p.type_map.count() == 9
    assert p.converted["events"].schema["ts"].dataType == T.TimestampNTZType()


# --------------------------------------------------------------------- reports, sources


def test_report_only_when_there_are_rows(spark, root):
    df = spark.createDataFrame([(1, "a")], "n int, s string").coalesce(1)
    assert not writers.write_report_tsv(df.limit(0), f"{root}/none") and not os.path.exists(f"{root}/none")
    assert writers.write_report_tsv(df, f"{root}/some")
    assert open(data_files(f"{root}/some", ".csv")[0]).read() == "n\ts\n1\ta\n"


def test_json_round_trip(spark, root):
    writers.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), f"{root}/j")
    assert open(data_files(f"{root}/j", ".json")[0]).read().strip() == '{"a":1,"b":null}'
    os.makedirs(f"{root}/arrays")
    with open(f"{root}/arrays/x.json", "w") as f:
        f.write('[\n {"TableName": "t", "TriggerName": "a"},\n {"TableName": "t", "TriggerName": "b"}\n]')
    schema = T.StructType([T.StructField("TableName", T.StringType()), T.StructField("TriggerName", T.StringType())])
    assert as_rows(sources.scan_json_array(spark, f"{root}/arrays", schema), "TriggerName") == [("t", "a"), ("t", "b")]


def test_untyped_sheets(spark, root):
    for sheet, text in (("b", "x,y\n1,2\n"), ("a", "p\n007\n")):
        os.makedirs(f"{root}/{sheet}")
        with open(f"{root}/{sheet}/0.csv", "w") as f:
            f.write(text)
    assert as_rows(sources.scan_untyped(spark, root)) == [("007",)]
    assert sources.scan_untyped(spark, root, "b").schema.simpleString() == "struct<x:string,y:string>"
    assert sources.scan_untyped(spark, root, "b", header=False).count() == 2
    with pytest.raises(ValueError, match="zz"):
        sources.scan_untyped(spark, root, "zz")


def test_object_listing(spark, root):
    os.makedirs(f"{root}/ext/2024/01/05")
    for name in ("2024/01/05/f.bin", "g.bin"):
        with open(f"{root}/ext/{name}", "w") as f:
            f.write("abc")
    got = {os.path.basename(r.path): r for r in sources.scan_objects(spark, root, "ext").collect()}
    assert got["f.bin"].as_of_date == D(2024, 1, 5) and got["f.bin"].date_type == "EXT"
    assert got["g.bin"].as_of_date is None and got["g.bin"].date_type is None and got["g.bin"].file_size_bytes == 3
    plan = sources.scan_objects(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_tables(spark, root):
    assert quoted(None, "my db", "ta`ble") == "`my db`.`ta``ble`"
    spark.sql("CREATE OR REPLACE TEMP VIEW `odd name` AS SELECT id FROM range(3)")
    assert scan_table(spark, "catalog", table="odd name").count() == 3
    spark.range(4).write.parquet(f"{root}/t")
    assert scan_table(spark, "parquet", f"{root}/t").count() == 4
    with pytest.raises(ValueError, match="partitionColumn"):
        scan_table(spark, "jdbc", "jdbc:none", table="t")
    assert scan_as_of(fx.table(spark, SF, "orders"), "o_orderdate", D(1900, 1, 1)).count() == 0


def test_delete_drops_partitions_only_of_the_days(spark, root):
    df = spark.createDataFrame([(1, D(2020, 1, 1)), (2, D(2020, 1, 2)), (3, None)], "id int, d date")
    df.write.partitionBy("d").parquet(f"{root}/t")
    writers.delete_as_of(spark, f"{root}/t", "d", [D(2020, 1, 1), D(2020, 1, 9)])
    assert as_rows(spark.read.parquet(f"{root}/t").select("id"), "id") == [(2,), (3,)]


def test_file_order(spark, root):
    spark.range(2000).orderBy("id").coalesce(1).write.csv(f"{root}/c")
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    df = sources.with_file_order(small.read.schema("id long").csv(f"{root}/c"))
    assert df.rdd.getNumPartitions() > 3
    assert [r.id for r in df.orderBy("seq").collect()] == list(range(2000))
