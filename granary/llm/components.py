"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, of the nodes in ``links`` (``a``, ``b``).

    Rounds of large and small stars: each node's larger neighbours, then its smaller ones, are
    hung below the smallest neighbour, until nothing moves. Every round is written, minima combine
    before the shuffle, and the lookups are equi joins whose hot centres are split. Repeated links, links
    in both directions and loops change nothing. No links give no rows.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(oriented(links), "links")
    before = state(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = oriented(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
        now = materialize(oriented(small), "links")
        after = state(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
