"""Snapshot stores, the merged file table, deletion by position, runs that are broken off."""

import datetime as dt
import glob
import os

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from granary import schemas
from granary.operators import archive
from granary.operators.retention import CONFIG
from granary.plans import archive as plan
from granary.plans.ingest import import_snapshot, ingest_feed, staged_rejects, staged_rows
from granary.registry import fixtures as fx
from granary.registry import version_queries
from granary.sinks import positions
from granary.sinks.file_table import FileTable
from granary.sinks.snapshots import CommitConflict, Snapshots
from granary.streaming.discovery import refresh_files, stream_upsert

D = dt.date
TS = dt.datetime(2024, 1, 5, 6, 7, 8)
SF = "/root/testdata/sf0.001"


class Killed(BaseException):
    """Stands for a driver that goes away: nothing catches it."""


def kill(*_, **__):
    raise Killed


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def data_files(path):
    return sorted(f for f in glob.glob(f"{path}/**/*.parquet", recursive=True) if "/." not in f and "/_" not in f[len(path):])


# ---------------------------------------------------------------------- snapshots


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_tables_of_a_store_change_together(spark, root):
    store = Snapshots(spark, f"{root}/s")
    assert store.version().number == 0 and store.read("a", "id long").count() == 0

    def write(*ids):
        return lambda path: spark.createDataFrame([(i,) for i in ids], "id long").write.parquet(path)

    store.load_all({"a": write(1, 2), "b": write(10)})
    between = {}

    def look(path):
        write(11)(path)
        # A reader while the second table is being written sees the first version whole.
        between.update({t: numbers(store.read(t, "id long")) for t in "ab"})

    store.load_all({"a": write(3), "b": look})
    assert between == {"a": [1, 2], "b": [10]}
    store.load("a", write(4), append=True)
    assert numbers(store.read("a", "id long")) == [3, 4] and numbers(store.read("b", "id long")) == [11]
    assert numbers(store.read("a", "id long", 1)) == [1, 2]
    assert store.rollback(1).number == 4 and numbers(store.read("b", "id long")) == [10]
    assert numbers(store.read("a", "id long", 3)) == [3, 4]
    with pytest.raises(ValueError):
        store.rollback(9)


def test_a_failed_load_leaves_no_version_and_no_data(spark, root):
    store = Snapshots(spark, f"{root}/s")
    spark.range(2).write.parquet(f"{root}/x")
    store.load("a", lambda p: spark.range(3).write.parquet(p))

    def half(path):
        spark.range(9).write.parquet(path)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.load_all({"b": lambda p: spark.range(1).write.parquet(p), "a": half})
    assert store.versions() == [1] and len(os.listdir(f"{root}/s/data")) == 1


def test_of_two_writers_one_fails(spark, root):
    one, two = Snapshots(spark, f"{root}/s"), Snapshots(spark, f"{root}/s")
    base = two.version()
    one.commit(base, {"a": ["data/x"]})
    with pytest.raises(CommitConflict):
        two.commit(base, {"a": ["data/y"]})
    assert one.version().folders == {"a": ["data/x"]} and os.listdir(f"{root}/s/_versions").count("0000000001.json") == 1


def test_expiry_keeps_what_newer_versions_read(spark, root):
    store = Snapshots(spark, f"{root}/s")
    for i in range(4):
        store.load("a", lambda p, i=i: spark.range(i + 1).write.parquet(p), append=i == 3)
    store.expire(2)
    assert store.versions() == [3, 4] and store.read("a", "id long").count() == 3 + 4
    assert len(os.listdir(f"{root}/s/data")) == 2


# ------------------------------------------------------------------------ staging


def test_staging_is_one_unit_read_once(spark, root):
    template = schemas.TEMPLATES["Template2"]
    rows = [("a", "1"), ("b", "-2"), ("c", "x"), ("d", ""), ("e", None)]
    spark.createDataFrame(rows, "ColumnA string, ColumnB string").write.parquet(f"{root}/in")
    df = spark.read.schema("ColumnA string, ColumnB string").parquet(f"{root}/in")
    store, names, rules = Snapshots(spark, f"{root}/s"), {"ColumnB": "b", "ColumnA": "a"}, [("positive", "b > 0")]
    for truncate, times in ((True, 1), (False, 2), (True, 1)):
        made = import_snapshot(df, template, store, rules, names, truncate)
        assert made.values == {"total_rows": 5 * times, "rejected_rows": 4 * times}
        key = lambda r: str(tuple(r))
        got = sorted(staged_rows(store, template, names).select("a", "b").collect(), key=key)
        assert got == sorted([("a", 1), ("b", -2), ("e", None)] * times, key=key)
        assert sorted(map(tuple, staged_rejects(store, template, names).collect())) == sorted(
            [("c", "x", "ColumnB"), ("d", "", "ColumnB")] * times)
    store.rollback(2)
    assert staged_rows(store, template, names).count() == 6
    with pytest.raises(ValueError, match="missing"):
        import_snapshot(df.drop("ColumnA"), template, store, rules)


def test_a_load_that_breaks_leaves_rows_and_rejects(spark, root, monkeypatch):
    template = schemas.TEMPLATES["Template2"]
    df = spark.createDataFrame([("a", "1"), ("c", "x")], "ColumnA string, ColumnB string")
    store = Snapshots(spark, f"{root}/s")
    import_snapshot(df, template, store, [])
    for failing in (df.withColumn("ColumnB", F.raise_error(F.lit("broken")).cast("string")), df):
        if failing is df:
            monkeypatch.setattr(Snapshots, "commit", kill)
        with pytest.raises((Exception, Killed)):
            import_snapshot(failing, template, store, [])
    assert staged_rows(store, template).count() == 1 and staged_rejects(store, template).count() == 1
    assert store.versions() == [1] and len(os.listdir(f"{root}/s/data")) == 1


class Jobs:
    """Spark jobs that run inside the block."""

    def __init__(self, spark):
        self.tracker, self.sc = spark.sparkContext.statusTracker(), spark.sparkContext

    def __enter__(self):
        self.group = f"counted-{id(self)}"
        self.sc.setJobGroup(self.group, "")
        return self

    def __exit__(self, *_):
        self.n = len(self.tracker.getJobIdsForGroup(self.group))
        self.sc.setJobGroup("other", "")


def test_counts_need_no_second_read(spark, root):
    with open(f"{root}/feed.txt", "w") as f:
        f.write("06|1|a\n\n07|2\n99|x\n06|3\n")
    with Jobs(spark) as jobs:
        counts = ingest_feed(spark, f"{root}/feed.txt", f"{root}/out")
    assert jobs.n == 1  # the write
    assert dict(as_rows(counts)) == {"product": 2, "inventory": 1, "_unrouted": 1, "_blank": 1}
    template = schemas.TEMPLATES["Template2"]
    spark.range(9).selectExpr("'a' AS ColumnA", "cast(id as string) AS ColumnB").write.parquet(f"{root}/in")
    df = spark.read.schema("ColumnA string, ColumnB string").parquet(f"{root}/in")
    with Jobs(spark) as jobs:
        made = import_snapshot(df, template, Snapshots(spark, f"{root}/s"), [("small", "ColumnB < 4")])
    assert jobs.n == 1 and made.values == {"total_rows": 9, "rejected_rows": 5}


# --------------------------------------------------------------------- file table


def file_rows(spark, *rows):
    """(configuration, date, path, size, created)"""
    frame = spark.createDataFrame(
        [(c, d, p, s, "Active", t) for c, d, p, s, t in rows],
        f"{CONFIG} int, as_of_date date, blob_path string, file_size_bytes long, status string, created_at_et timestamp_ntz")
    return archive.as_archival_files(frame)


def listed(table):
    return {(r[CONFIG], r.as_of_date, r.blob_path): (r.id, r.file_size_bytes) for r in table.read().collect()}


def test_merge_rewrites_only_the_months_it_hits(spark, root):
    table = FileTable(spark, f"{root}/t")
    days = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 2, 1), None]
    table.merge(file_rows(spark, *[(c, d, f"/{c}/{d}", 1, TS) for c in (10, 20) for d in days]))
    first = listed(table)
    assert sorted(i for i, _ in first.values()) == list(range(1, 9))
    before = {f: os.stat(f).st_mtime_ns for f in data_files(f"{root}/t/data")}
    later = TS + dt.timedelta(hours=1)
    table.merge(file_rows(spark, (10, days[0], f"/10/{days[0]}", 5, later), (10, days[1], "/new", 7, later), (10, D(2021, 5, 5), "/more", 8, later),
                          (10, days[1], f"/10/{days[1]}", 99, TS - dt.timedelta(hours=1))))
    now = listed(table)
    assert now[10, days[0], f"/10/{days[0]}"] == (first[10, days[0], f"/10/{days[0]}"][0], 5)  # the known file keeps its id
    assert now[10, days[1], f"/10/{days[1]}"] == first[10, days[1], f"/10/{days[1]}"]  # an older row does not win
    assert sorted(i for i, _ in now.values()) == list(range(1, 11)) and len(now) == 10
    kept = [f for own in table.store.version().folders.values() for f in own]
    used = {f for f in before if any(k in f for k in kept)}
    assert len(used) == len(before) - 1 and all(os.stat(f).st_mtime_ns == before[f] for f in used)
    assert len(table.read(1).collect()) == 8


def test_merging_again_changes_nothing(spark, root):
    table = FileTable(spark, f"{root}/t")
    rows = file_rows(spark, *[(10, D(2020, 1, 1 + i % 20), f"/f{i}", i, TS) for i in range(200)], (None, None, "/none", 0, TS))
    table.merge(rows, done={"batch": 1})
    first = listed(table)
    assert len(first) == 201 and len({i for i, _ in first.values()}) == 201
    table.merge(rows)
    assert listed(table) == first
    number = table.store.version().number
    assert table.merge(rows.withColumn("file_size_bytes", F.lit(5)), done={"batch": 1}).number == number and listed(table) == first
    table.merge(rows.limit(0))
    assert listed(table) == first


def test_no_task_numbers_all_files_without_a_date(spark, root):
    """Files of one date, or of none, are dealt over tasks; their numbers still follow date, configuration and path."""
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(off, "false")
    try:
        table = FileTable(spark, f"{root}/t")
        rows = file_rows(spark, *[(10, D(2020, 1, 1) if i % 8 == 0 else None, f"/f{i:04}", i, TS) for i in range(800)])
        table.merge(rows.where("file_size_bytes % 2 = 0"))
        table.merge(rows)
    finally:
        spark.conf.set(off, "true")
    by_place = ["as_of_date", CONFIG, "blob_path"]
    known, fresh = ([p for _, p in as_rows(table.read().where(f"file_size_bytes % 2 = {odd}").orderBy("id").select("id", "blob_path"))] for odd in (0, 1))
    assert known == [p for (p,) in as_rows(rows.where("file_size_bytes % 2 = 0").orderBy(*by_place).select("blob_path"))]
    assert fresh == [p for (p,) in as_rows(rows.where("file_size_bytes % 2 = 1").orderBy(*by_place).select("blob_path"))]
    assert numbers(table.read().select("id")) == list(range(1, 801)) and table.store.version().values["last_id"] == 800
    steps = [spark.read.parquet(f).count() for f in data_files(f"{root}/t/steps")]
    assert max(steps) < 400 // 2


def test_a_merge_that_breaks_changes_nothing(spark, root, monkeypatch):
    table = FileTable(spark, f"{root}/t")
    table.merge(file_rows(spark, (10, D(2020, 1, 1), "/a", 1, TS)))
    monkeypatch.setattr(Snapshots, "commit", kill)
    with pytest.raises(Killed):
        table.merge(file_rows(spark, (10, D(2020, 1, 1), "/a", 2, TS)))
    monkeypatch.undo()
    assert listed(table) == {(10, D(2020, 1, 1), "/a"): (1, 1)}
    table.merge(file_rows(spark, (10, D(2020, 1, 1), "/a", 2, TS)))
    assert listed(table) == {(10, D(2020, 1, 1), "/a"): (1, 2)}


# ------------------------------------------------------------- deletion by position


def test_positions_hide_rows_and_no_file_changes(spark, root):
    spark.range(40).withColumn("copy", F.lit(1)).repartition(4).write.parquet(f"{root}/t")
    before = {f: os.stat(f).st_mtime_ns for f in data_files(f"{root}/t")}
    rows = positions.with_place(spark.read.parquet(f"{root}/t"))
    positions.mark_deleted(rows.where("id % 3 = 0"), f"{root}/t", "one")
    positions.mark_deleted(rows.where("id < 5"), f"{root}/t", "two")
    positions.mark_deleted(rows, f"{root}/t", "two")  # that name has been used
    left = [i for i in range(40) if i % 3 and i >= 5]
    live = positions.read_live(spark, f"{root}/t")
    assert numbers(live.select("id")) == left and live.columns == ["id", "copy"]
    assert {f: os.stat(f).st_mtime_ns for f in data_files(f"{root}/t")} == before
    spark.range(100, 102).withColumn("copy", F.lit(1)).write.mode("append").parquet(f"{root}/t")  # has no marks
    assert positions.merge_deletes(spark, f"{root}/t", files_per_pass=1) == 4
    assert numbers(spark.read.parquet(f"{root}/t").select("id")) == [*left, 100, 101]
    assert positions.merge_deletes(spark, f"{root}/t") == 0 and not os.path.exists(f"{root}/t/_deletes")


def test_merge_in_a_partitioned_table_keeps_its_layout(spark, root):
    spark.range(20).selectExpr("id", "id % 2 AS a", "concat('x ', id % 3) AS b").write.partitionBy("a", "b").parquet(f"{root}/k=1/t")
    rows = positions.with_place(spark.read.parquet(f"{root}/k=1/t"))
    positions.mark_deleted(rows.where("id < 10"), f"{root}/k=1/t", "x")
    positions.merge_deletes(spark, f"{root}/k=1/t", 2)
    left = spark.read.parquet(f"{root}/k=1/t")
    assert sorted(tuple(r) for r in left.select("id", "a", "b").collect()) == [(i, i % 2, f"x {i % 3}") for i in range(10, 20)]
    assert set(os.listdir(f"{root}/k=1/t")) <= {"a=0", "a=1", "_SUCCESS", "._SUCCESS.crc"}


@pytest.mark.parametrize("step, calls", [("remove", 2), ("move", 1), ("move", 2)])
def test_a_merge_that_was_cut_off_is_finished(spark, root, monkeypatch, step, calls):
    spark.range(40).repartition(4).write.parquet(f"{root}/t")
    positions.mark_deleted(positions.with_place(spark.read.parquet(f"{root}/t")).where("id % 2 = 0"), f"{root}/t", "x")
    real, seen = getattr(positions, step), []

    def cut(*args):
        seen.append(args)
        if len(seen) == calls:
            raise Killed
        return real(*args)

    monkeypatch.setattr(positions, step, cut)
    with pytest.raises(Killed):
        positions.merge_deletes(spark, f"{root}/t", 2)
    monkeypatch.undo()
    positions.merge_deletes(spark, f"{root}/t", 2)
    assert numbers(spark.read.parquet(f"{root}/t")) == list(range(1, 40, 2))
    assert not [f for f in os.listdir(f"{root}/t") if f.startswith("_merge")]


# --------------------------------------------------------------------- broken runs


def orders(spark, root, name, partitioned):
    rows = spark.range(400).selectExpr("id", "date_add(DATE'2023-01-01', cast(id % 40 as int)) AS as_of_date", "id * 2 AS v").repartition(3)
    (rows.write.partitionBy("as_of_date") if partitioned else rows.write).parquet(f"{root}/{name}/src")


def run_of(spark, root, name, partitioned, table=None):
    keep = schemas.retention_policies(spark).withColumn("keep_last_eod", F.lit(5))
    return plan.archive_table(
        spark, f"{root}/{name}/src", "as_of_date", 10, schemas.table_configurations(spark), keep,
        schemas.lifecycle_policies(spark), table or FileTable(spark, f"{root}/{name}/files"), fx.exemptions(spark),
        f"{root}/{name}/out", 7, TS, rows_per_part=4, partitioned=partitioned)


def outcome(spark, root, name, run):
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    return {
        "details": rows(spark.read.parquet(run.details), "as_of_date", "date_type", "phase", "status", "rows_affected", "file_path", "error_message"),
        "moved": rows(spark.read.parquet(run.data), "id", "archive_date", "v"),
        "left": rows(spark.read.parquet(f"{root}/{name}/src"), "id", "as_of_date", "v"),
        "files": rows(FileTable(spark, f"{root}/{name}/files").read(), "id", "as_of_date", "row_count", "status"),
        "header": rows(spark.read.parquet(run.header), "id", "status"),
    }


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    root, out = str(tmp_path_factory.mktemp("whole")), {}
    for partitioned in (True, False):
        orders(spark, root, f"w{partitioned}", partitioned)
        out[partitioned] = outcome(spark, root, f"w{partitioned}", run_of(spark, root, f"w{partitioned}", partitioned))
    return out


BREAKS = [(False, w) for w in ("retention.archive_decisions", "read_part_files", "FileTable.merge", "mark_deleted", "merge_deletes", "_log_header")]
BREAKS += [(True, w) for w in ("delete_as_of", "log_run_details")]


@pytest.mark.parametrize("partitioned, where", BREAKS)
def test_a_run_goes_on_where_it_was_broken_off(spark, root, monkeypatch, unbroken, where, partitioned):
    orders(spark, root, "b", partitioned)
    monkeypatch.setattr(f"granary.plans.archive.{where}", kill)
    with pytest.raises(Killed):
        run_of(spark, root, "b", partitioned)
    monkeypatch.undo()
    run = run_of(spark, root, "b", partitioned)
    assert outcome(spark, root, "b", run) == unbroken[partitioned]
    if where == "_log_header":  # a run that has ended is not done again
        assert outcome(spark, root, "b", run_of(spark, root, "b", partitioned)) == unbroken[partitioned]
    assert not [f for f in glob.glob(f"{root}/b/**/_staged*", recursive=True)]


def test_a_run_without_due_dates_moves_nothing(spark, monkeypatch):
    """A file table or an exemption that covers every date leaves no part to read back."""
    held = schemas.local_table(spark, [(1, 10, None, "Table", "hold")], schemas.EXEMPTION)
    monkeypatch.setattr(fx, "exemptions", lambda _: held)
    found = as_rows(version_queries.archive_resume_rows(spark, SF).select("doc_id", "place"), "doc_id")
    assert found == [(i, "left") for (i,) in as_rows(fx.table(spark, SF, "documents").select("doc_id"), "doc_id")]


def test_a_failed_run_takes_up_its_dates_again(spark, root, monkeypatch, unbroken):
    orders(spark, root, "b", False)
    real, bad = plan.write_parts, D(2023, 1, 20)

    def picky(df, path, *args, **kw):
        if df.where(F.col("archive_date") == F.lit(bad)).count():
            raise RuntimeError("bad date")
        return real(df, path, *args, **kw)

    monkeypatch.setattr(plan, "write_parts", picky)
    run = run_of(spark, root, "b", False)
    assert spark.read.parquet(run.header).first().status == "Failed"
    assert spark.read.parquet(f"{root}/b/src").where(F.col("as_of_date") == F.lit(bad)).count() == 10
    # Rows that come for a date already moved stay where they are.
    spark.sql("SELECT 900L AS id, DATE'2023-01-03' AS as_of_date, 1L AS v").write.mode("append").parquet(f"{root}/b/src")
    monkeypatch.undo()
    got, whole = outcome(spark, root, "b", run_of(spark, root, "b", False)), unbroken[False]
    assert got["moved"] == whole["moved"] and got["header"] == whole["header"]
    assert sorted(got["left"]) == sorted([*whole["left"], (900, D(2023, 1, 3), 1)])
    assert sorted(f[1:] for f in got["files"]) == sorted(f[1:] for f in whole["files"])
    assert len({f[0] for f in got["files"]}) == len(got["files"])


# ----------------------------------------------------------------------- discovery


def put(root, name, text):
    os.makedirs(os.path.dirname(f"{root}/in/{name}"), exist_ok=True)
    with open(f"{root}/in/{name}", "w") as f:
        f.write(text)


def sizes(table):
    return {os.path.basename(r.blob_path): (r.file_size_bytes, r.id) for r in table.read().collect()}


def test_changed_objects_update_their_row(spark, root):
    table = FileTable(spark, f"{root}/t")
    put(root, "2024-01-05/a", "x")
    put(root, "2024-01-05/b", "xx")
    refresh_files(spark, f"{root}/in", 20, table)
    assert {k: v[0] for k, v in sizes(table).items()} == {"a": 1, "b": 2}
    ids = {k: v[1] for k, v in sizes(table).items()}
    put(root, "2024-01-05/a", "longer")
    put(root, "2024-02-01/c", "xyz")
    number = refresh_files(spark, f"{root}/in", 20, table).number
    assert {k: v[0] for k, v in sizes(table).items()} == {"a": 6, "b": 2, "c": 3}
    assert {k: sizes(table)[k][1] for k in ids} == ids
    assert refresh_files(spark, f"{root}/in", 20, table).number == number  # nothing has changed


def test_stream_merges_a_batch_once(spark, root):
    table = FileTable(spark, f"{root}/t")
    put(root, "2024-01-05/a", "x")
    go = lambda ck: stream_upsert(spark, f"{root}/in", 20, table, f"{root}/{ck}").awaitTermination()
    go("ck")
    put(root, "2024-01-06/b", "x")
    go("ck")
    first, number = sizes(table), table.store.version().number
    assert set(first) == {"a", "b"}
    go("ck")
    # The last batch runs again, as if its commit had been lost.
    for name in glob.glob(f"{root}/ck/commits/*1") + glob.glob(f"{root}/ck/commits/.*1.crc"):
        os.remove(name)
    go("ck")
    assert sizes(table) == first and table.store.version().number == number


# ---------------------------------------------------- arrays and dates of folders


def test_arrays_are_bounded_and_split_at_objects(spark, root):
    from granary.sinks.writers import write_json_arrays
    from granary.sources.files import scan_json_array, scan_json_lines_array

    rows = [("hot" if i % 4 else "b", i, text) for i, text in enumerate(["x", "a],[", "},{", "line\nbreak", "ends ]", " [", ",", None, "é\t"] * 30)]
    df = spark.createDataFrame(rows, "g string, k long, v string")
    write_json_arrays(df, f"{root}/a", ["g"], "k", 7, rows_per_slice=50)
    arrays = spark.read.text(f"{root}/a", wholetext=True).collect()
    import json
    sizes = [len(json.loads(r.value)) for r in arrays]
    assert sum(sizes) == len(rows) and max(sizes) == 7
    assert all(len({x["g"] for x in json.loads(r.value)}) == 1 for r in arrays)
    for scan in (scan_json_array, scan_json_lines_array):
        assert sorted(map(tuple, scan(spark, f"{root}/a", df.schema).collect()), key=str) == sorted(rows, key=str)


def test_dates_of_folders_read_no_column(spark, root):
    from granary.operators.retention import as_of_dates_of_folders

    spark.range(30).selectExpr("id", "date_add(DATE'2024-01-01', cast(id % 3 as int)) AS d").write.partitionBy("d").parquet(f"{root}/t")
    got = as_of_dates_of_folders(spark, f"{root}/t", "d")
    assert sorted(r[0].day for r in got.collect()) == [1, 2, 3]
    assert "ReadSchema: struct<>" in got._jdf.queryExecution().toString()
