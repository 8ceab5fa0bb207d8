"""Delta-maintained token rollups: additive totals by source, language and tokenizer version.

A batch of signed changes (insert, delete, revise) becomes one small table of sums per group.
Totals are the sum of the committed batches. A batch is written to a folder named by its
id and counts once its commit marker (Spark's own ``_SUCCESS``) is there; committing an id again changes
nothing, and a batch that broke off is written anew.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
DELTA = T.StructType([T.StructField(c, T.StringType()) for c in GROUP] + [T.StructField(c, T.LongType()) for c in SUMS])

INSERT, DELETE, REVISE = "insert", "delete", "revise"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def counted(docs: DataFrame, tokenizers: Mapping[str, Column]) -> DataFrame:
    """One row per document and tokenizer version with its token count; null counts as 0."""
    each = F.array(*[
        F.struct(F.lit(name).alias("tokenizer"), F.coalesce(n.cast("long"), F.lit(0).cast("long")).alias("tokens"))
        for name, n in tokenizers.items()
    ])
    return docs.withColumn("count_", F.explode(each)).select("source", "lang", "count_.*")


def delta(changes: DataFrame) -> DataFrame:
    """Sums of a batch of changes.

    ``changes``: the group columns, ``op``, ``tokens`` and, for a revision, ``old_tokens``. An
    insert adds a document, a delete takes one off, a revision moves tokens by new - old and
    leaves the number of documents. Null source or language is a group of its own. Sums
    combine before the shuffle, so one large group costs a row per task. An unknown ``op`` fails.
    """
    sign = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).when(F.col("op") == REVISE, 0)
    sign = F.coalesce(sign, F.raise_error(F.lit("unknown change")).cast("int"))
    moved = F.when(sign == 0, F.col("tokens") - F.col("old_tokens")).otherwise(sign * F.col("tokens"))
    return changes.groupBy(*GROUP).agg(
        F.sum(sign.cast("long")).alias("n_docs"), F.sum(moved.cast("long")).alias("n_tokens"))


class Rollup:
    """Totals kept as committed batches below ``path``, a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-." for c in batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.path}/batch={batch_id}"

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes`` once; False if the batch was there already."""
        where = self._batch(batch_id)
        if _exists(self.spark, f"{where}/_SUCCESS"):
            return False
        delta(changes).write.mode("overwrite").parquet(where)
        return True

    def compact(self, batch_ids: list[str], into: str) -> bool:
        """Merge committed batches into one under a new id, for callers that then use it instead."""
        where = self._batch(into)
        if _exists(self.spark, f"{where}/_SUCCESS"):
            return False
        self.totals(batch_ids).write.mode("overwrite").parquet(where)
        return True

    def totals(self, batch_ids: list[str]) -> DataFrame:
        """Current totals over the named batches; groups that went back to nothing are gone."""
        done = [b for b in batch_ids if _exists(self.spark, f"{self._batch(b)}/_SUCCESS")]
        parts = [self.spark.read.schema(DELTA).parquet(self._batch(b)) for b in done]
        rows = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], DELTA))
        summed = rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.where("n_docs <> 0 or n_tokens <> 0")
