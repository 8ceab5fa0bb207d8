"""Table sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from granary.operators.archive import on_date


def quoted(*names: str | None) -> str:
    """Dotted identifier with each part in backticks."""
    return ".".join("`" + n.replace("`", "``") + "`" for n in names if n)


def scan_table(
    spark: SparkSession, provider: str, location: str | None = None,
    database: str | None = None, schema: str | None = None, table: str | None = None,
    **options: str,
) -> DataFrame:
    """A table from the catalog, from files, or over JDBC.

    For JDBC give ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` so that the read is split.
    """
    if provider == "catalog":
        return spark.table(quoted(database, schema, table))
    if provider == "jdbc":
        missing = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} - options.keys()
        if missing:
            raise ValueError(f"a JDBC scan needs {', '.join(sorted(missing))}")
        name = ".".join(n for n in (schema, table) if n)
        return spark.read.format("jdbc").option("dbtable", name).options(url=location, **options).load()
    return spark.read.format(provider).options(**options).load(location)


def scan_as_of(df: DataFrame, column: str, day: dt.date) -> DataFrame:
    """Rows of one as-of date, whatever their time of day."""
    return on_date(df, column, day)
