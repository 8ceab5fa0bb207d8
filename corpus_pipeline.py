"""From raw documents to token files: the stages of a training corpus.

Each stage gets the rows its predecessor kept, as Parquet. All but the last return the
columns of ``documents``, others that it has included; the last returns one row per written document. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, jaccard_join, mixing, quality_rules, token_files
from granary.llm.common import drop, materialize, scratch, table
from granary.session import shared_dir

#: Near-duplicates of a corpus share 80 percent of their five-word shingles; op 7's query has its own measure.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy does not reject. Null and empty texts have too few words and go; equal rows share a verdict."""
    return quality_rules.keep(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones, that with the smallest doc_id; of rows with one id, and of ids that are
    null, the first one read. Documents without words are similar to nothing and stay."""
    return jaccard_join.keep_one(docs, k=NEAR_WORDS, threshold=NEAR_PERCENT)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null texts hold none; an empty benchmark keeps all documents."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target wants them. A null source is one of its own, repeated rows are separate
    documents, and a source without words has no copies."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; per written document its place, length and checksum. A null text is its end id alone; null
    ids come first, and rows of one id are in the order of a hash of their texts."""
    path = shared_dir(spark, "corpus-tokens")
    token_files.write_tokens(docs, path)
    return token_files.token_starts(spark, path)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", without_test_items),
    ("mixing sources", mixture),
    ("token files", tokens),
]

#: Token ids cannot be expressed in SQL; tests compare with a brute-force run instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, *read, *made[:-1])
        read = made[-1:]
    written = STAGES[-1][1](spark, docs, sf_dir)
    drop(spark, *read)
    return written
