"""Two-file enrichment: the preferred measure of file B for each deal of file A."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import clean_trim, same_text
from granary.operators.joins import lookup_left

# Indicator sub types and the filter of the second variant.
PREFERRED = "settleDatePosition"
FALLBACK = "OriginalTradeAmount"
CATEGORY = "InventoryPosition"
INDICATOR_TYPE = "Nominal"


def trade_key(col: Column) -> Column:
    """Case-insensitive key; null when there is no trade id."""
    return F.nullif(F.upper(clean_trim(col)), F.lit(""))


def resolve_measures(file_b: DataFrame, seq: str, filtered: bool = False) -> DataFrame:
    """One measure per trade: the last non-blank preferred value, else the last fallback.

    "Last" follows the column ``seq``. A trade with neither keeps a null measure. The
    maximum combines on the map side, so a hot trade sends one row per task.
    """
    sub_type = F.upper(clean_trim(F.col("indicator_sub_type")))
    priority = F.when(sub_type == PREFERRED.upper(), 2).when(sub_type == FALLBACK.upper(), 1)
    b = file_b
    if filtered:
        b = b.where(
            same_text(clean_trim(F.col("category")), CATEGORY)
            & same_text(clean_trim(F.col("indicator_type")), INDICATOR_TYPE)
        )
    rows = b.select(
        trade_key(F.col("trade_id")).alias("trade_key"),
        priority.alias("priority"),
        F.nullif(clean_trim(F.col("measure_value")), F.lit("")).alias("measure"),
        F.col(seq).alias("seq"),
    ).where(F.col("trade_key").isNotNull())
    usable = F.col("priority").isNotNull() & F.col("measure").isNotNull()
    rank = F.when(usable, F.struct("priority", "seq"))
    return rows.groupBy("trade_key").agg(F.max_by("measure", rank).alias("measure_value"))


def provider_deals(
    file_a: DataFrame, measures: DataFrame, run_date: dt.date, hot_rows: int = 1_000_000
) -> DataFrame:
    """File A rows that carry a trade id, with their measure and the audit date."""
    text = ["deal_id", "trade_id", "book_code", "tsip", "provider_id"]
    a = file_a.withColumns({c: clean_trim(F.col(c)) for c in text})
    a = a.where(F.length("trade_id") > 0)
    joined = lookup_left(a, measures, trade_key(F.col("trade_id")), "trade_key", hot_rows)
    return joined.select(
        *text, "trade_date", "business_date", "settlement_date", "buy_price",
        "measure_value", F.lit(run_date).alias("created_on"),
    )
