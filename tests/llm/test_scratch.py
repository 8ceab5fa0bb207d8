"""Shuffle files and intermediate tables go once nothing reads them any more."""

import os
import time

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from granary.llm import jaccard_join, token_files, warc
from granary.llm.common import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def folders(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def documents(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.md5(F.concat_ws(",", F.col("id") % 20, i))))
    return spark.range(60).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("s").alias("source"))


def archive(spark, path):
    pages = documents(spark).select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    warc.write_warc(warc.plan_records(pages), path)


WRITES = {
    "warc": archive,
    "tokens": lambda spark, path: token_files.write_tokens(documents(spark), path),
    "table": lambda spark, path: materialize(documents(spark).groupBy("text").count(), "test"),
}


@pytest.mark.parametrize("name", WRITES)
def test_a_write_keeps_no_shuffle_files(spark, tmp_path, name):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    WRITES[name](spark, str(tmp_path / "out"))
    ends = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < ends:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == setting


def test_the_join_keeps_only_what_its_result_reads(spark):
    before = folders(spark)
    kept = jaccard_join.keep_one(documents(spark))
    labels = {f.rpartition("-")[0] for f in folders(spark) - before}
    assert labels == {"granary-join-rows", "granary-join-others"}
    assert as_rows(kept.select("doc_id"), "doc_id") == [(i,) for i in range(20)]


def test_components_leave_one_table(spark):
    before = folders(spark)
    found = jaccard_join.join(documents(spark).withColumn("row_id", F.col("doc_id")))
    labels = sorted(f.rpartition("-")[0] for f in folders(spark) - before)
    assert labels == ["granary-join-sets", "granary-join-signatures", "granary-links"]
    assert as_rows(found.select("doc_id", "component_id"), "doc_id") == [(i, i % 20) for i in range(60)]
