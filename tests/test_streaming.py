import os

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from granary import schemas
from granary.sinks.writers import routed_counts
from granary.streaming.discovery import known_files, stream_discovery
from granary.streaming.feeds import stream_feed


def drop(root, name, *lines):
    os.makedirs(f"{root}/in", exist_ok=True)
    with open(f"{root}/in/{name}", "w") as f:
        f.write("".join(line + "\n" for line in lines))


def run(spark, root, **kw):
    stream_feed(spark, f"{root}/in", f"{root}/out", f"{root}/ck", **kw).awaitTermination()
    return dict(as_rows(routed_counts(spark, f"{root}/out")))


def test_each_file_is_taken_once(spark, tmp_path):
    root = str(tmp_path)
    seen = []
    hook = lambda df, batch: seen.append((batch, df.count()))
    drop(root, "1.txt", "06|1", "", "zz|1")
    assert run(spark, root, tee=f"{root}/tee", on_batch=hook) == {"product": 1, "_blank": 1, "_unrouted": 1}
    assert run(spark, root, tee=f"{root}/tee", on_batch=hook) == {"product": 1, "_blank": 1, "_unrouted": 1}
    drop(root, "2.txt", "06|2")
    drop(root, "3.txt", "12|3")
    assert run(spark, root, tee=f"{root}/tee", on_batch=hook) == {"product": 2, "deals": 1, "_blank": 1, "_unrouted": 1}
    assert seen == [(0, 3), (1, 2)]
    teed = spark.read.text(f"{root}/tee").select("value")
    assert sorted(r[0] for r in teed.collect()) == ["", "06|1", "06|2", "12|3", "zz|1"]


def test_replay_overwrites_its_batch(spark, tmp_path):
    root = str(tmp_path)
    drop(root, "1.txt", "06|1", "07|1")

    def fail(df, batch):
        raise RuntimeError("injected")

    with pytest.raises(Exception, match="injected"):
        run(spark, root, on_batch=fail)
    assert run(spark, root) == {"product": 1, "inventory": 1}


def test_inputs_move_one_batch_late(spark, tmp_path):
    root = str(tmp_path)
    drop(root, "1.txt", "06|1")
    run(spark, root, clean_to=f"{root}/done")
    assert os.path.exists(f"{root}/in/1.txt")
    drop(root, "2.txt", "06|2")
    assert run(spark, root, clean_to=f"{root}/done") == {"product": 2}
    assert not os.path.exists(f"{root}/in/1.txt")


def test_discovery_registers_new_objects(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/in/a/2024/01/05")
    os.makedirs(f"{root}/in/b")

    def put(name):
        with open(f"{root}/in/{name}", "w") as f:
            f.write("x")

    go = lambda: stream_discovery(spark, f"{root}/in", 20, f"{root}/out", f"{root}/ck").awaitTermination()
    put("a/2024/01/05/f")
    go()
    put("b/g")
    go()
    none = spark.createDataFrame([], schemas.ARCHIVAL_FILE)
    files = known_files(spark, none, f"{root}/out")
    got = {os.path.basename(r.blob_path): (str(r.as_of_date), r.date_type, r.status) for r in files.collect()}
    assert got == {"f": ("2024-01-05", "EXT", "Active"), "g": ("None", None, "Active")}
    again = known_files(spark, files.withColumn("status", F.lit("Created")), f"{root}/out")
    assert {r.status for r in again.collect()} == {"Active"} and again.count() == 2


def test_discovery_opens_no_object(spark, tmp_path):
    folder = tmp_path / "in" / "2024-01-05"
    folder.mkdir(parents=True)
    (folder / "a.bin").write_bytes(b"x" * 100)
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "10")
    try:
        stream_discovery(spark, str(tmp_path / "in"), 20, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    finally:
        spark.conf.unset(key)
    assert [r.file_size_bytes for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [100]
