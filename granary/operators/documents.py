"""Nested and textual reports, text search, and the shape of JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.json import shape_type
from granary.functions.text import contains_pattern, lines_of
from granary.operators.numbering import chunk_rows


def _ordered(item: Column) -> Column:
    """Items of a chunk in row order; a chunk is bounded, so this list is too."""
    pairs = F.array_sort(F.collect_list(F.struct("row_no", item.alias("item"))))
    return F.transform(pairs, lambda p: p["item"])


def nested_json(
    rows: DataFrame, group: list[str], seq: str, item: Column, list_name: str,
    rows_per_chunk: int,
) -> DataFrame:
    """One JSON object per group with the group's rows as a list in source order.

    Groups beyond ``rows_per_chunk`` rows continue in further chunks, so no group has to
    fit one row or one task.
    """
    chunked = chunk_rows(rows, group, seq, rows_per_chunk)
    lists = chunked.groupBy(*group, "chunk").agg(_ordered(item).alias(list_name))
    body = F.to_json(F.struct(*group, list_name))
    return lists.select(*group, "chunk", F.size(list_name).alias("items"), body.alias("json"))


def ordered_text(
    rows: DataFrame, group: list[str], seq: str, text: Column, separator: str,
    rows_per_chunk: int,
) -> DataFrame:
    """Rows joined to one text per group in the order of ``seq``, in bounded chunks."""
    chunked = chunk_rows(rows.withColumn("_text", text), group, seq, rows_per_chunk)
    return chunked.groupBy(*group, "chunk").agg(F.array_join(_ordered(F.col("_text")), separator).alias("body"))


def grouped_names(
    rows: DataFrame, group: list[str], seq: str, name: str, rows_per_chunk: int
) -> DataFrame:
    """Names per group in source order."""
    chunked = chunk_rows(rows, group, seq, rows_per_chunk)
    return chunked.groupBy(*group, "chunk").agg(_ordered(F.col(name)).alias("names"))


def text_search(docs: DataFrame, pattern: str) -> DataFrame:
    return docs.where(contains_pattern(F.col("text"), pattern))


def text_search_summary(docs: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(contains_pattern(F.col("text"), pattern)).alias("matching"),
    )


def matching_lines(docs: DataFrame, key: str, pattern: str) -> DataFrame:
    """Lines of each text that match, with their 0-based number."""
    lines = docs.select(key, F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(pattern))


def json_shape(df: DataFrame, column: str) -> DataFrame:
    """Key paths of the JSON objects in a column, with the kinds of value they hold.

    Objects are opened level by level until no value is an object.
    """
    spark = df.sparkSession
    level = df.select(F.lit("").alias("prefix"), F.try_parse_json(F.col(column)).alias("object"))
    level = level.where(F.schema_of_variant("object").startswith("OBJECT"))
    found = None
    while found is None or not level.isEmpty():
        level = level.lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).select(
            F.concat("prefix", "key").alias("path"), "value", shape_type(F.col("value")).alias("kind")
        )
        pairs = level.select("path", "kind")
        found = pairs if found is None else found.unionByName(pairs)
        level = level.where(F.schema_of_variant("value").startswith("OBJECT")).select(
            F.concat("path", F.lit(".")).alias("prefix"), F.col("value").alias("object")
        )
    return found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def json_schema(df: DataFrame, column: str) -> DataFrame:
    """The one schema all JSON values of the column fit."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("schema"))


def inner_join_report(parents: DataFrame, children: DataFrame, objects: DataFrame) -> DataFrame:
    """Three-level name report, sorted by all three names."""
    return (
        objects.join(children, "child_key").join(parents, "parent_key")
        .select("parent_name", "child_name", "object_name")
        .orderBy("parent_name", "child_name", "object_name")
    )
