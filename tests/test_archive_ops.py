import datetime as dt

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from granary import schemas
from granary.functions.paths import date_in_path, file_tags
from granary.operators import archive
from granary.operators.retention import CONFIG, MSG_EMPTY

D = dt.date


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (10, [10]), (11, [10, 1]), (20, [10, 10])])
def test_part_sizes(spark, n, sizes):
    df = spark.createDataFrame([(D(2020, 1, 1), n)], "as_of_date date, n_rows long")
    assert [r["row_count"] for r in archive.part_sizes(df, 10).orderBy("part_index").collect()] == sizes


def test_assigned_parts_have_the_planned_sizes(spark):
    df = spark.range(1, 1001).withColumn("as_of_date", F.when(F.col("id") < 800, D(2020, 1, 1)).otherwise(D(2020, 1, 2)))
    got = archive.assign_parts(df, archive.content_slice(["id"]), 30)
    sizes = got.groupBy("as_of_date", "part_index").agg(F.count("*").alias("row_count"))
    planned = archive.part_sizes(df.groupBy("as_of_date").agg(F.count("*").alias("n_rows")), 30)
    assert sizes.exceptAll(planned).count() == 0 and got.select("id").distinct().count() == 1000


def test_upsert_takes_the_newest_and_prefers_incoming(spark):
    schema = f"{CONFIG} int, as_of_date date, blob_path string, status string, u int"
    old = spark.createDataFrame([(1, None, "a", "Created", 1), (1, D(2020, 1, 1), "b", "Created", 5),
                                 (1, D(2020, 1, 1), "c", "Created", 3)], schema)
    new = spark.createDataFrame([(1, None, "a", "Active", 1), (1, D(2020, 1, 1), "b", "Active", 4),
                                 (2, None, "a", "Active", 1)], schema)
    got = as_rows(archive.upsert_files(old, new, "u"), CONFIG, "blob_path")
    assert got == [(1, None, "a", "Active", 1), (1, D(2020, 1, 1), "b", "Created", 5),
                   (1, D(2020, 1, 1), "c", "Created", 3), (2, None, "a", "Active", 1)]


def test_survivors_keep_rows_without_date(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 7)), (2, None), (3, dt.datetime(2020, 1, 2))], "id int, ts timestamp_ntz")
    assert as_rows(archive.survivors(df, "ts", D(2020, 1, 1)).select("id"), "id") == [(2,), (3,)]
    assert as_rows(archive.on_date(df, "ts", D(2020, 1, 1)).select("id")) == [(1,)]


def test_run_details(spark):
    d = [D(2020, 1, i) for i in range(1, 5)]
    decisions = spark.createDataFrame(
        [(10, d[0], "EOD", None, "Export"), (10, d[1], "EOM", None, "Export"), (10, d[2], "EOD", "why", "Skipped")],
        f"{CONFIG} int, as_of_date date, date_type string, message string, decision string",
    )
    exported = spark.createDataFrame([(10, d[0], 7, 1, "/p")], f"{CONFIG} int, as_of_date date, row_count long, part_count long, file_path string")
    counts = spark.createDataFrame([(10, d[0], 7, 6)], f"{CONFIG} int, as_of_date date, expected_rows long, actual_rows long")
    got = {(r.as_of_date, r.phase): r for r in archive.run_details(decisions, exported, archive.delete_reconcile(counts), 5).collect()}
    assert len(got) == 4
    assert (got[d[0], "Export"].status, got[d[0], "Export"].rows_affected, got[d[0], "Export"].file_path) == ("Success", 7, "/p")
    assert (got[d[1], "Export"].status, got[d[1], "Export"].error_message) == ("Skipped", MSG_EMPTY)
    assert (got[d[2], "Export"].status, got[d[2], "Export"].error_message) == ("Skipped", "why")
    delete = got[d[0], "Delete"]
    assert (delete.status, delete.error_message) == ("Success", "ExpectedDeleteCount=7,ActualDeleted=6")


@pytest.mark.parametrize("path, day", [
    ("a/2024/01/05/f.parquet", D(2024, 1, 5)),
    ("a\\2024-01-05\\x", D(2024, 1, 5)),
    ("a//2024//01/05", D(2024, 1, 5)),
    ("2024/13/45/2024-02-30/2023/12/31", D(2023, 12, 31)),
    ("a/2024-01-05.csv", None), ("a/x2024/01/05", None), ("a/2024/1/5", None), ("a/20240105/f", None),
    ("2024/01/05", D(2024, 1, 5)), ("a/2024/02/30/05", None), ("", None), (None, None),
])
def test_date_in_path(spark, path, day):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(date_in_path(F.col("p"))).first()[0] == day


def test_tags_hold_only_what_is_known(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 2), "EOD", "t", True), (2, None, None, None, False)],
                               "c int, d date, k string, p string, e boolean")
    col = [F.col(x) for x in "cdkpe"]
    full, bare = (r[0] for r in df.orderBy("c").select(file_tags(*col)).collect())
    assert full == {"archival_table_configuration_id": "1", "archival_policy": "t", "archival_exempt": "true",
                    "archival_date": "2020-01-02", "archival_date_type": "EOD"}
    assert bare == {"archival_table_configuration_id": "2", "archival_policy": "", "archival_exempt": "false"}


def test_manifest_fits_the_file_schema(spark):
    parts = spark.createDataFrame([(10, D(2020, 1, 2), "EOD", 3, 5, 99)],
                                  f"{CONFIG} int, as_of_date date, date_type string, part_index int, row_count long, file_size_bytes long")
    made = archive.manifest(parts, schemas.table_configurations(spark), schemas.lifecycle_policies(spark),
                            spark.createDataFrame([], schemas.EXEMPTION), dt.datetime(2020, 2, 1))
    row = made.first()
    assert row.blob_path == "/TestDb/dbo/transactions/2020/01/02.part-00003.parquet"
    assert row.tags["archival_part_index"] == "3"
    assert archive.as_archival_files(made).schema.names == schemas.ARCHIVAL_FILE.names
