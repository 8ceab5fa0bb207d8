"""Registered queries of the package against their SQL, values and types."""

import itertools
import os
import re

import pytest

import corpus_pipeline
from granary.llm.oracles import ORACLES
from granary.llm.queries import QUERIES
from granary.registry.compare import connect, differences, run_oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR).toArrow(), run_oracle(connect(SF_DIR), ORACLES[name])) == []


def firsts_of_groups(rows):
    """Smallest doc_id of each group that five-word sets of 80 percent link, all pairs compared."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {top(i) for i in sets}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (3, "", "en", "s", 0), (4, None, "en", None, 0)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    """No documents, or none that a stage can use, and columns with names that the stages use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "1 AS row_id", "2 AS copy", "3 AS leaks", "4 AS ledger").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_runs_stage_by_stage(spark):
    from granary.llm import decontaminate, jaccard_join, mixing, quality_rules

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    kept = quality_rules.keep(docs)
    single = jaccard_join.keep_one(kept, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert {r[0] for r in single.select("doc_id").collect()} == firsts_of_groups(kept.select("doc_id", "text").collect())
    clean = decontaminate.clean(single, benchmark)
    mixed = mixing.mix(clean)
    assert {tuple(d.columns) for d in (kept, single, clean, mixed)} == {tuple(docs.columns)}
    ids = sorted(r[0] for r in mixed.select("doc_id").collect())
    got = corpus_pipeline.run(spark, SF_DIR).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    sizes = [d.count() for d in (docs, kept, single, clean)]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
