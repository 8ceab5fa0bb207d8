"""Exact row numbers for groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, group: list[str], order: list[Column], slice_by: Column, out: str = "row_no",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """1-based ``row_number`` per group, large groups spread over many tasks.

    ``slice_by`` must never decrease along ``order``. Groups of more than ``hot_rows`` rows,
    at most rows/hot_rows of them, are numbered slice by slice and each slice is shifted by
    the size of the slices before it, so only their per-slice counts meet in one task.
    """
    hot = (
        df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        .select(*group, F.lit(True).alias("_hot"))
    )
    sliced = df.join(F.broadcast(hot), group, "left").withColumn("_slice", F.when(F.col("_hot"), slice_by))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.where("_hot").groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_slice", F.sum("_n").over(before).alias("_before"))
    )
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_within", F.row_number().over(within))
        .join(offsets, [*group, "_slice"], "left")
        .withColumn(out, F.col("_within") + F.coalesce("_before", F.lit(0)))
        .drop("_hot", "_slice", "_within", "_before")
    )


#: Quantiles of a hot group's keys that slices are taken from, and the rank error of their sketch, 1 / ACCURACY of the group.
QUANTILES, ACCURACY = 1 << 11, 1 << 15


def quantile_slices(df: DataFrame, group: list[str], seq: str, rows_per_slice: int, out: str) -> DataFrame:
    """Add ``out``, the 0-based slice of each row of a group of more than ``rows_per_slice`` rows; null in smaller groups.

    Slices follow ``seq`` and are cut at quantiles of the group's own keys, two per ``rows_per_slice`` rows, so
    clustered keys and outliers do not gather rows in one slice. A group has at most QUANTILES slices; one that has more than
    half as many million rows gets larger ones. Rows of equal ``seq`` share a slice.
    """
    # At most rows / rows_per_slice groups, so the lists of them always fit a broadcast.
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_slice)
    same = F.expr(" and ".join(f"d.`{g}` <=> h.`{g}`" for g in group))
    keys = df.select(*group, seq).alias("d").join(F.broadcast(hot.alias("h")), same).select("d.*", "h._rows")
    points = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    cuts = keys.groupBy(*group).agg(F.percentile_approx(seq, points, ACCURACY).alias("_all"), F.first("_rows").alias("_rows"))
    wanted = F.greatest(F.ceil(2 * F.col("_rows") / F.lit(rows_per_slice)), F.lit(2))
    step = F.greatest(F.floor(F.lit(QUANTILES) / wanted), F.lit(1))
    bounds = F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % step == 0)).alias("_bounds")
    placed = df.alias("d").join(F.broadcast(cuts.select(*group, bounds).alias("h")), same, "left").select("d.*", "_bounds")
    # How many bounds lie below the key, by halving.
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(QUANTILES.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda at, by: F.when(
        (at + by <= F.size("_bounds")) & (F.try_element_at("_bounds", at + by) < F.col(seq)), at + by).otherwise(at))
    return placed.withColumn(out, F.when(F.col("_bounds").isNotNull(), below)).drop("_bounds")


def chunk_rows(
    df: DataFrame, group: list[str], seq: str, rows_per_chunk: int, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Number rows by an integer ``seq`` and cut each group into chunks of bounded size.

    Adds ``row_no`` and the 0-based ``chunk``. A group of more than ``rows_per_slice`` rows is
    numbered slice by slice, see :func:`quantile_slices`.
    """
    placed = quantile_slices(df, group, seq, rows_per_slice, "_share")
    numbered = number_rows(placed, group, [F.col(seq)], F.coalesce("_share", F.lit(0)), hot_rows=rows_per_slice).drop("_share")
    return numbered.withColumn("chunk", F.expr(f"(row_no - 1) div {rows_per_chunk}"))
