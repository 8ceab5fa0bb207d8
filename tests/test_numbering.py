import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators.numbering import chunk_rows, number_rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i) for i in rng.sample(range(10_000), 2_000)]
    return spark.createDataFrame(data, "g string, seq int").repartition(5)


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_same_as_plain_row_number(rows, hot_rows):
    w = Window.partitionBy("g").orderBy("seq")
    expected = rows.withColumn("n", F.row_number().over(w).cast("long"))
    got = number_rows(rows, ["g"], [F.col("seq")], F.expr("seq div 37"), "n", hot_rows)
    got = got.withColumn("n", F.col("n").cast("long"))
    assert got.count() == rows.count()
    assert got.exceptAll(expected).count() == 0


def test_chunks_are_bounded_and_ordered(rows):
    c = chunk_rows(rows, ["g"], "seq", 100)
    sizes = c.groupBy("g", "chunk").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z"))
    w = Window.partitionBy("g").orderBy("chunk")
    bad = sizes.withColumn("prev", F.lag("z").over(w)).where("n > 100 OR a <= prev")
    assert bad.count() == 0


def test_far_apart_keys_make_few_slices(spark):
    from granary.operators.numbering import chunk_rows

    df = spark.range(4000).selectExpr("'g' as g", "abs(xxhash64(id)) as k").unionByName(
        spark.range(5).selectExpr("'small' as g", "id * 1000000007 as k"))
    got = chunk_rows(df, ["g"], "k", 10, rows_per_slice=100)
    rows = [r for r in got.collect() if r.g == "g"]
    rows.sort(key=lambda r: r.k)
    assert [r.row_no for r in rows] == list(range(1, 4001)) and [r.chunk for r in rows] == [i // 10 for i in range(4000)]
    low, high = rows[0].k, rows[-1].k
    slices = {int((r.k - low) // ((high - low + 1) / 80)) for r in rows}
    assert len(slices) <= 81


def test_outliers_and_clusters_fill_no_slice(spark):
    from granary.operators.numbering import quantile_slices

    # Keys in two far clusters and one outlier, and a group without a name.
    df = spark.range(20_000).selectExpr(
        "if(id % 2 = 0, 'g', null) AS g", "CASE WHEN id < 2 THEN 9000000000000000000 WHEN id % 3 = 0 THEN id ELSE 1000000000000 + id END AS k")
    df = df.unionByName(spark.range(50).selectExpr("'small' AS g", "id AS k"))
    got = quantile_slices(df, ["g"], "k", 1000, "s").groupBy("g", "s").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("z"))
    rows = sorted(got.collect(), key=lambda r: (str(r.g), r.s or 0))
    assert [(r.s, r.n) for r in rows if r.g == "small"] == [(None, 50)]
    for g in ("g", None):
        own = [r for r in rows if r.g == g]
        assert sum(r.n for r in own) == 10_000 and len(own) >= 15
        assert max(r.n for r in own) <= 2 * 500  # twice the target at most
        assert all(x.z < y.a for x, y in zip(own, own[1:]))
    chunks = chunk_rows(df, ["g"], "k", 7, rows_per_slice=1000).where("g = 'g'").orderBy("k").collect()
    assert [r.row_no for r in chunks] == list(range(1, 10_001)) and [r.chunk for r in chunks] == [i // 7 for i in range(10_000)]
