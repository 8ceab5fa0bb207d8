"""Dates, cutoffs and time zones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(moment: dt.datetime) -> Column:
    """Literal without a zone, the same in every session zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def parse_iso_date(col: Column) -> Column:
    """Strict ``yyyy-MM-dd``; anything else is null."""
    return F.try_to_date(col, "yyyy-MM-dd")


def format_iso_date(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def stamp(col: Column) -> Column:
    """Time stamp used in file names."""
    return F.date_format(col, "yyyyMMdd_HHmmss")


def cutoff(run_date: Column, days: Column) -> Column:
    return F.date_sub(run_date, days)


def local_to_utc(col: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` -> wall-clock time in UTC, both without zone.

    Where clocks are set back, an ambiguous local time is read as standard time,
    that is the later of its two instants.
    """
    day = F.expr("INTERVAL 1 DAY")
    early = F.convert_timezone(F.lit(zone), F.lit("UTC"), col)
    # The offset in force a day later, whatever the size of the change.
    late = F.convert_timezone(F.lit(zone), F.lit("UTC"), col + day) - day
    again = F.convert_timezone(F.lit("UTC"), F.lit(zone), late)
    return F.when(again == col, F.greatest(early, late)).otherwise(early)


def local_to_instant(col: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` -> TimestampType, whatever the session zone."""
    epoch = wall_clock(dt.datetime(1970, 1, 1))
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, local_to_utc(col, zone)))
