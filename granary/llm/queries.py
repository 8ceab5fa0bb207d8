"""Queries of the package: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    conversations, decontaminate, jaccard_join, language_id, lexical_search, mixing, pii, quality_rules, sharding, suffix_dedup,
    token_counts, token_files, warc,
)
from granary.llm.common import WORD, materialize, table
from granary.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf):
    """Measurements, base verdict and the verdict of the newest policy of every document."""
    ledger = quality_rules.add_ledger(table(spark, sf, "documents"))
    bits = F.col("ledger.fail_bits")
    return ledger.select(
        "doc_id", *[F.col(f"ledger.{m}").alias(m) for m in quality_rules.MEASURES], bits.alias("fail_bits"),
        quality_rules.rejected(bits, quality_rules.BASE).alias("base_failed"),
        (~quality_rules.rejected(bits, quality_rules.POLICIES[-1])).alias("kept"))


@query
def op2_suffix_dedup(spark, sf):
    """What is removed of every document, and the checksum of what stays."""
    return suffix_dedup.dedup(table(spark, sf, "documents"))


@query
def op3_pii(spark, sf):
    """Base and learned spans of every document."""
    found = pii.find(table(spark, sf, "documents"))
    kinds = F.transform("base", lambda s: s.kind)
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("all")).alias("spans"))


@query
def op4_language_id(spark, sf):
    """Predicted language of every document."""
    docs = table(spark, sf, "documents")
    found = docs.withColumn("found", language_id.predict(docs, language_id.fit(docs), F.col("text")))
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


@query
def op5_token_files(spark, sf):
    """Token files of every document, and what they say when read back."""
    path = shared_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf, "documents"), path)
    return token_files.token_starts(spark, path)


@query
def op6_mixing(spark, sf):
    """Words that the mixture takes of every document."""
    return mixing.copies(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_jaccard_join(spark, sf):
    """Component of every document under the join."""
    docs = table(spark, sf, "documents").withColumn("row_id", F.monotonically_increasing_id())
    return jaccard_join.join(docs).select("doc_id", "n_shingles", "component_id")


@query
def op8_warc(spark, sf):
    """Archives of every page, as read back."""
    path = shared_dir(spark, "warc")
    warc.write_warc(warc.plan_records(table(spark, sf, "pages")), path, segment=4096, chunk=1024)
    return warc.read_warc(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_decontamination(spark, sf):
    """Documents that hold a passage of a test item, one row per document and item."""
    found = decontaminate.add_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


#: Versions whose counts are kept: words, and words with punctuation marks apart.
TOKENIZERS = {"words": WORD, "words_marks": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\x5B-`{-~]"}


@query
def op10_token_counts(spark, sf):
    """Totals after three batches: all documents by words; a revision that gives lines of their
    own to the version that parts punctuation; removal of texts that repeat an earlier
    document. The second batch is committed twice.
    """
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "lang", *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias(t) for t, p in TOKENIZERS.items()],
        F.sha2("text", 256).alias("digest"))
    ledger = materialize(docs, "token-ledger")
    first = ledger.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    repeats = ledger.join(first, "digest").where("doc_id > first_id")

    def changes(rows: DataFrame, op: str, tokens: dict[str, str], old: str = "cast(null as long)") -> DataFrame:
        each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(c).alias("tokens")) for t, c in tokens.items()])
        return rows.withColumn("each", F.explode(each)).select(
            "source", "lang", "each.*", F.lit(op).alias("op"), F.expr(old).alias("old_tokens"))

    rollup = token_counts.Rollup(spark, shared_dir(spark, "token-rollup"))
    # The second version starts out with the plain counts and is then revised.
    rollup.commit("1", changes(ledger, token_counts.INSERT, {"words": "words", "words_marks": "words"}))
    for _ in range(2):
        rollup.commit("2", changes(ledger, token_counts.REVISE, {"words_marks": "words_marks"}, "words"))
    rollup.commit("3", changes(repeats, token_counts.DELETE, {t: t for t in TOKENIZERS}))
    return rollup.totals(["1", "2", "3"])


@query
def op11_conversation_repair(spark, sf):
    """Faults of every damaged conversation, and its cheapest repair."""
    return conversations.summaries(conversations.damage(table(spark, sf, "conversations")))


@query
def op12_sharding(spark, sf):
    """Shard of every document under the balanced map, and its place in that shard."""
    return sharding.assign(table(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query
def op13_lexical_search(spark, sf):
    """The 50 best documents for every test item."""
    path = shared_dir(spark, "lexical-index")
    lexical_search.write_index(table(spark, sf, "documents"), path)
    return lexical_search.search(spark, path, table(spark, sf, "benchmark")).select("item_id", "rank", "doc_id", "score")
