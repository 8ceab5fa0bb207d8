"""Rows numbered by their place in files: no copies of the documents are written, whatever the files are."""

from __future__ import annotations

import collections
import os

import corpus_pipeline
from pyspark.sql import functions as F
from test_scratch import documents, folders

from granary.llm import jaccard_join, mixing
from granary.llm.common import by_place, counted_rows, listed, materialize


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def written(spark, path, rows=60, files=3):
    documents(spark).limit(rows).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_write_no_copy_of_the_documents(spark, tmp_path):
    docs = written(spark, str(tmp_path / "a b%20c"))
    before = folders(spark)
    kept = jaccard_join.keep_one(docs)
    assert {f.rpartition("-")[0] for f in folders(spark) - before} == {"granary-join-others"}
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    before = folders(spark)
    mixed = mixing.mix(docs)
    assert {f.rpartition("-")[0] for f in folders(spark) - before} == {"granary-mix-copies"}
    assert bag(mixed) == bag(docs) and "Exchange hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_parts_of_files(spark, tmp_path):
    docs = written(spark, str(tmp_path / "docs"))
    some = docs.where("doc_id % 3 = 1")  # places with gaps: written first
    for rows in (docs, some, docs.where("false"), docs.unionByName(docs), documents(spark)):
        placed = by_place(rows, "test-rows")
        assert placed.select("row_id").distinct().count() == rows.count() and bag(placed.select("row.*")) == bag(rows)
        assert bag(mixing.mix(rows)) == bag(rows)
        counts = materialize(listed(placed.select("row_id", (F.col("row.doc_id") % 4).alias("n"))), "test-counts")
        assert bag(counted_rows(placed, counts).select("row.doc_id", "n")) == bag(rows.where("doc_id % 4 > 0").select("doc_id", F.expr("doc_id % 4")))


def test_lists_of_many_rows(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 100_000, 1, 2).selectExpr("id as doc_id").write.parquet(path)
    rows = by_place(spark.read.parquet(path), "test-rows")
    n = F.pmod(F.hash("row.doc_id"), F.lit(4))
    counts = materialize(listed(rows.select("row_id", n.alias("n"))), "test-counts")
    got = counted_rows(rows, counts).select("row.doc_id", "n")
    assert counts.count() > 2 and got.exceptAll(rows.select("row.doc_id", n.cast("long"))).count() == 0
    assert got.count() == rows.where(n > 0).count()


def test_the_pipeline_keeps_its_token_files_alone(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    before = folders(spark)
    assert corpus_pipeline.run(spark, sf).count()
    assert {f.rpartition("-")[0] for f in folders(spark) - before} == {"granary-corpus-tokens"}
