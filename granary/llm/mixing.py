"""Systematic sampling: mix sources to target weights by whole documents.

All documents of a source have the same expected number of copies, target / size. Prefix
sums of the expected copies run over the source's documents in order of size, one random
offset is added, and a document is emitted once per integer boundary its interval crosses.
Since neighbours in the order are alike in size, the words taken stay close to the target.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, by_place, counted_rows, drop, listed, materialize, scratch

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Documents of one size that are ranked in one window group.
SLICE_ROWS = 10_000


def _uniform(text: Column, salt: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for each text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources, one row each: ``source``, ``source_size`` -> ``target``, ``weight``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Raising all shares in step
    with the weights until each is at its cap or the total is spent gives what resharing the
    excess step by step ends at: with sources by cap per weight, those capped are a prefix.
    The rows are one per source, so the two ordered windows hold names, not documents.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    name = (F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(Window.orderBy(*name))
    # Exact: products of totals and weights pass 64 bits on large inputs.
    cap = (F.col("source_size") * MAX_COPIES).cast("decimal(38,0)")
    weighed = sizes.withColumn("weight", F.element_at(weights, F.pmod(place - 1, F.lit(len(WEIGHTS))).cast("int") + 1))
    by_cap = Window.orderBy(F.col("source_size").cast("double") / F.col("weight"), *name)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        weighed
        .withColumn("r", F.row_number().over(by_cap))
        .withColumn("l", F.sum("source_size").over(everything) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MAX_COPIES)
        .withColumn("w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # All earlier ones are capped as well if this one is.
        .withColumn("capped", cap * F.col("w") <= F.col("l").cast("decimal(38,0)") * F.col("weight"))
        .withColumn("first", F.min(F.when(~F.col("capped"), F.struct("r", "l", "w"))).over(everything))
    )
    free = F.col("weight") * F.col("first.l").cast("double") / F.col("first.w")
    return level.select(
        "source", "source_size", "weight", F.when(F.col("capped"), cap.cast("double")).otherwise(free).alias("target")
    )


def _measured(rows: DataFrame, *more: str) -> DataFrame:
    """The documents of ``row_id``, ``doc_id``, ``text``, ``source`` measured, written once."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return materialize(rows.select("row_id", "source", size.alias("size"), key.alias("key"), *more), "mix-rows")


def _copies(rows: DataFrame, seed: str) -> DataFrame:
    """``row_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` of each numbered row."""
    slim = rows.select("row_id", "source", "size", "key")
    by_size = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    by_source = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(by_source)
    # Slices of a size: the leading hex digits of the key, in the order of the key itself.
    digits = F.ceil(F.log(16.0, F.greatest(F.col("n") / SLICE_ROWS, F.lit(1.0)))).cast("int")
    placed = slim.alias("a").join(
        by_size.withColumn("digits", digits).alias("b"), F.expr("a.source <=> b.source and a.size = b.size")
    ).select("a.*", F.expr("left(a.key, b.digits)").alias("slice"))
    cells = placed.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    sums = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    start_size = by_size.withColumn("at", F.coalesce(F.sum("n").over(sums), F.lit(0)))
    sums = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        cells.withColumn("in_size", F.coalesce(F.sum("n").over(sums), F.lit(0))).alias("a")
        .join(start_size.alias("b"), F.expr("a.source <=> b.source and a.size = b.size"))
        .join(goal.alias("g"), F.expr("a.source <=> g.source"))
        .select("a.source", "a.size", "a.slice", F.expr("a.in_size + b.at").alias("start"), "g.source_size", "g.target")
    )
    within = Window.partitionBy("source", "size", "slice").orderBy("key", "row_id")
    ranked = placed.withColumn("rank", F.row_number().over(within)).alias("a").join(
        start.alias("b"), F.expr("a.source <=> b.source and a.size = b.size and a.slice = b.slice"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = (F.col("start") + F.col("rank")).cast("double")
    offset = _uniform(F.coalesce(F.col("a.source"), F.lit("")), seed)
    crossed = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return ranked.select("row_id", "a.source", "a.size", "source_size", "target", crossed.cast("long").alias("copies"))


def copies(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` per row of ``docs``.

    A null text has size 0. A source without words has target 0 and no copies. Repeated rows
    are separate documents; which of several identical rows is taken makes no difference.
    Other columns are not read. Ranks come from counts per (source, size, slice), so a source
    or a size that holds most documents is spread over many window groups.
    """
    rows = _measured(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", "source"), "doc_id")
    return _copies(rows, seed).join(rows.select("row_id", "doc_id"), "row_id").select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixture itself: rows of ``docs`` with their own columns, each as often as it is taken."""
    rows = by_place(docs, "mix-docs")
    with scratch() as made:
        measured = _measured(rows.select("row_id", "row.doc_id", "row.text", "row.source"))
    taken = materialize(listed(_copies(measured, seed).select("row_id", F.col("copies").alias("n"))), "mix-copies")
    drop(docs.sparkSession, *made)
    return counted_rows(rows, taken).withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select("row.*")
