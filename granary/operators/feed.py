"""Multi-record feeds: one text line per record, the record type in the first field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import non_blank
from granary.schemas import FEED_ROUTES

Routes = dict[str, tuple[str, int]]

UNROUTED = "_unrouted"
BLANK = "_blank"


def record_type(value: Column) -> Column:
    return F.substring_index(value, "|", 1)


def records(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their record type and fields; trailing empty fields stay."""
    return lines.where(non_blank(F.col("value"))).select(
        "value", record_type(F.col("value")).alias("record_type"),
        F.split("value", "[|]", -1).alias("fields"),
    )


def pad_truncate(fields: Column, width: int, empty_as_null: bool = False) -> list[Column]:
    """Exactly ``width`` columns: missing fields become empty, extra ones are dropped."""
    out = []
    for i in range(1, width + 1):
        value = F.coalesce(F.try_element_at(fields, F.lit(i)), F.lit(""))
        if empty_as_null:
            value = F.nullif(value, F.lit(""))
        out.append(value.alias(f"col{i}"))
    return out


def route(
    lines: DataFrame, kind: str, routes: Routes = FEED_ROUTES, empty_as_null: bool = False
) -> DataFrame:
    """Rows of one record type as ``col1..colN``; ``col1`` is the type itself."""
    _, width = routes[kind]
    rows = records(lines).where(F.col("record_type") == kind)
    return rows.select(*pad_truncate(F.col("fields"), width, empty_as_null))


def unrouted(lines: DataFrame, routes: Routes = FEED_ROUTES) -> DataFrame:
    """Lines of types no route takes."""
    return records(lines).where(~F.col("record_type").isin(*routes)).select("record_type", "value")


def destination(value: Column, routes: Routes = FEED_ROUTES) -> Column:
    """Table a line belongs to, or one of the two reject partitions."""
    out = F.lit(UNROUTED)
    for kind, (table, _) in routes.items():
        out = F.when(record_type(value) == kind, table).otherwise(out)
    return F.when(non_blank(value), out).otherwise(BLANK)


def routed_rows(
    lines: DataFrame, routes: Routes = FEED_ROUTES, empty_as_null: bool = False
) -> DataFrame:
    """Every line of the feed, keyed by ``table_name``, for one partitioned write.

    The columns are those of the widest route; narrower routes leave the rest null.
    Only lines of the reject partitions keep their text.
    """
    value = F.col("value")
    split = lines.withColumn("table_name", destination(value, routes)).withColumn(
        "fields", F.split(value, "[|]", -1)
    )
    widths = {table: width for table, width in routes.values()}
    columns = pad_truncate(F.col("fields"), max(widths.values()), empty_as_null)
    bounded = [
        F.when(F.col("table_name").isin(*[t for t, w in widths.items() if w > i]), col).alias(
            f"col{i + 1}"
        )
        for i, col in enumerate(columns)
    ]
    rejected = F.when(F.col("table_name").isin(UNROUTED, BLANK), value).alias("value")
    return split.select("table_name", *bounded, rejected)


def record_type_counts(lines: DataFrame) -> DataFrame:
    return (
        lines.where(non_blank(F.col("value")))
        .groupBy(record_type(F.col("value")).alias("record_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def feed_totals(lines: DataFrame, routes: Routes = FEED_ROUTES) -> DataFrame:
    """Lines read, blank ones among them, and how many each route took."""
    target = lines.select(destination(F.col("value"), routes).alias("target"))
    counts = {"blank_lines": BLANK, "unrouted_lines": UNROUTED}
    counts |= {f"{table}_lines": table for table, _ in routes.values()}
    return target.agg(
        F.count(F.lit(1)).alias("lines_read"),
        *[F.count_if(F.col("target") == t).alias(name) for name, t in counts.items()],
    )
