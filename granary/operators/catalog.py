"""Scans driven by table schemas: pick columns by type, then test or convert them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.dates import local_to_instant
from granary.functions.text import class_name, column_name_clean

Tables = dict[str, DataFrame]

# Integer and bit types the 0/1 test covers.
BINARY_TYPES = ("int", "tinyint", "boolean")

# SQL type -> property type, and which types take a null mark.
TARGET_TYPES = {
    "bigint": "long",
    "binary": "byte[]",
    "boolean": "bool",
    "date": "DateTime",
    "decimal": "decimal",
    "double": "double",
    "float": "float",
    "int": "int",
    "smallint": "short",
    "string": "string",
    "timestamp": "DateTimeOffset",
    "timestamp_ntz": "DateTime",
    "tinyint": "byte",
}
NULL_MARKED = (
    "bigint", "boolean", "date", "decimal", "double", "float", "int", "smallint",
    "timestamp", "timestamp_ntz", "tinyint",
)
MAX_LENGTH_BELOW = 1000


def table_list(text: str) -> list[str]:
    """Comma-separated list; empty elements stay and simply match nothing."""
    return text.split(",")


def _chosen(tables: Tables, names: list[str] | None) -> Tables:
    return {n: df for n, df in tables.items() if names is None or n in names}


def _type_name(field: T.StructField) -> str:
    return field.dataType.typeName() if isinstance(field.dataType, T.DecimalType) else (
        field.dataType.simpleString()
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _unpivot(stats: DataFrame, fields: list[tuple[int, T.StructField]], table: str, *names: str):
    """One row per column from a single aggregated row with columns ``name_i``."""
    rows = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(_type_name(f)).alias("data_type"), F.lit(i).alias("ordinal"),
            *[F.col(f"{n}_{i}").alias(n) for n in names],
        )
        for i, f in fields
    ])
    return stats.select(F.lit(table).alias("table_name"), F.inline(rows))


def columns_by_type(
    tables: Tables, types: tuple[str, ...], names: list[str] | None = None
) -> DataFrame:
    """Columns of the given types with their row and null counts, one pass per table."""
    parts = []
    for table, df in _chosen(tables, names).items():
        fields = [(i, f) for i, f in enumerate(df.schema, 1) if _type_name(f) in types]
        if not fields:
            continue
        counts = [
            c
            for i, f in fields
            for c in (
                F.count(F.lit(1)).alias(f"n_rows_{i}"),
                F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n_nulls_{i}"),
            )
        ]
        parts.append(_unpivot(df.agg(*counts), fields, table, "n_rows", "n_nulls"))
    return _union(parts)


def binary_columns(tables: Tables, types: tuple[str, ...] = BINARY_TYPES) -> DataFrame:
    """Columns that hold nothing but 0, 1 and null, all columns of a table in one pass."""
    parts = []
    for table, df in tables.items():
        fields = [(i, f) for i, f in enumerate(df.schema, 1) if _type_name(f) in types]
        if not fields:
            continue
        tests = []
        for i, f in fields:
            value = F.col(f"`{f.name}`").cast("int")
            within = (F.min(value) >= 0) & (F.max(value) <= 1)
            tests.append(F.coalesce(within, F.lit(True)).alias(f"is_binary_{i}"))
        parts.append(_unpivot(df.agg(*tests), fields, table, "is_binary"))
    return _union(parts).where("is_binary").select("table_name", "column_name")


def target_type(data_type: Column) -> Column:
    out = F.concat(F.lit("UNKNOWN_"), data_type)
    for name, target in TARGET_TYPES.items():
        out = F.when(data_type == name, target).otherwise(out)
    return out


def catalog_type_map(tables: Tables, key_name: str = "id") -> DataFrame:
    """Per column: target type, null mark, required mark and length, from the data itself.

    ``declared`` marks the lengths that stand in a declaration: those below the limit.
    """
    parts = []
    for table, df in tables.items():
        fields = list(enumerate(df.schema, 1))
        stats = []
        for i, f in fields:
            col = F.col(f"`{f.name}`")
            length = F.length(col) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("int")
            stats += [
                F.coalesce(F.bool_or(col.isNull()), F.lit(True)).alias(f"has_null_{i}"),
                F.max(length).alias(f"longest_{i}"),
            ]
        parts.append(_unpivot(df.agg(*stats), fields, table, "has_null", "longest"))
    data_type, has_null = F.col("data_type"), F.col("has_null")
    return _union(parts).select(
        class_name(F.col("table_name")).alias("class_name"),
        column_name_clean(F.col("column_name")).alias("column_name"),
        "ordinal", "data_type",
        target_type(data_type).alias("target_type"),
        F.when(has_null & data_type.isin(*NULL_MARKED), "?").otherwise("").alias("null_mark"),
        (~has_null & (F.lower("column_name") != key_name)).alias("required"),
        F.col("longest").alias("max_length"),
        F.coalesce(F.col("longest") < MAX_LENGTH_BELOW, F.lit(False)).alias("declared"),
    )


def convert_timestamps(
    tables: Tables, table_names: str | None = None, zone: str = "America/New_York"
) -> Tables:
    """Read zone-less timestamps of the listed tables as local time in ``zone``.

    Other tables and columns come back unchanged; converted columns are instants.
    """
    chosen = _chosen(tables, None if table_names is None else table_list(table_names))
    out = dict(tables)
    for table, df in chosen.items():
        local = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
        out[table] = df.withColumns({c: local_to_instant(F.col(f"`{c}`"), zone) for c in local})
    return out
