"""Join shapes that need care with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_left(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: str, hot_rows: int = 1_000_000
) -> DataFrame:
    """``left`` with the one matching row of ``right``, or nulls.

    ``right`` must hold each key once. A key with more than ``hot_rows`` rows on the left is
    salted: its rows spread by the task they come from, and its one row on the right is
    repeated per salt. At most rows/hot_rows keys are hot, so their list broadcasts. Rows
    without a key spread too. Adaptive execution broadcasts ``right`` if it is small.
    """
    keyed = left.withColumn("_key", left_key)
    n = F.col("_n")
    hot = (
        keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_key").isNotNull() & (n > hot_rows))
        .select("_key", F.ceil(n / F.lit(hot_rows)).cast("int").alias("_salts"))
    )
    # The task number, unlike a random number, is the same when a task runs again.
    task = F.spark_partition_id()
    salt = (
        F.when(F.col("_key").isNull(), task)
        .when(F.col("_salts").isNotNull(), F.pmod(task, F.col("_salts")))
        .otherwise(0)
    )
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread = keyed.join(F.broadcast(hot), "_key", "left").withColumn("_salt", salt).drop("_salts")
    values = (
        right.withColumnRenamed(right_key, "_key").join(F.broadcast(hot), "_key", "left")
        .withColumn("_salt", F.explode(salts)).drop("_salts")
    )
    return spread.join(values, ["_key", "_salt"], "left").drop("_key", "_salt")
