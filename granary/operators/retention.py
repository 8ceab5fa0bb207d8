"""Which as-of dates to keep and which to archive.

Everything after ``as_of_dates`` works on distinct dates, a few thousand per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.schemas import DATE_TYPES

CONFIG = "table_configuration_id"

# Run-detail messages.
MSG_ARCHIVED = "Already archived (archival_file exists)."
MSG_EXEMPT = "Table/date is exempt from archival."
MSG_EMPTY = "Export produced no rows."


def as_of_dates(source: DataFrame, column: str) -> DataFrame:
    """Distinct as-of dates of a table; rows without one are left alone."""
    day = F.to_date(F.col(column)).alias("as_of_date")
    return source.select(day).where(F.col("as_of_date").isNotNull()).distinct()


def as_of_dates_of_folders(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct as-of dates of a table laid out by ``column``, from its folders alone.

    The folders' names give the values; no data column is read, and folders without rows do not count.
    """
    return as_of_dates(spark.read.parquet(path), column)


def date_types(dates: DataFrame) -> DataFrame:
    """Label each (configuration, date) EOD, EOM, EOQ or EOY, the strongest label winning.

    A date ends its period when it is the last one there and the period is closed: a
    later date exists, or it is the last calendar day.
    """
    d = F.col("as_of_date")
    year, quarter, month = F.year(d), F.quarter(d), F.month(d)
    latest = F.max(d).over(Window.partitionBy(CONFIG))

    def ends(period: list[Column], last_day: Column) -> Column:
        newest = F.max(d).over(Window.partitionBy(CONFIG, *period))
        return (newest == d) & ((latest > d) | (last_day == d))

    quarter_end = F.last_day(F.make_date(year, quarter * 3, F.lit(1)))
    year_end = F.make_date(year, F.lit(12), F.lit(31))
    kind = (
        F.when(ends([year], year_end), "EOY")
        .when(ends([year, quarter], quarter_end), "EOQ")
        .when(ends([year, month], F.last_day(d)), "EOM")
        .otherwise("EOD")
    )
    return dates.select(CONFIG, "as_of_date", kind.alias("date_type"))


def keep_limit(date_type: Column) -> Column:
    """How many dates of a type the retention policy keeps."""
    out = F.lit(None).cast("int")
    for name in DATE_TYPES:
        out = F.when(date_type == name, F.col(f"keep_last_{name.lower()}")).otherwise(out)
    return out


def _ranked(typed: DataFrame, configs: DataFrame, policies: DataFrame) -> DataFrame:
    policy = policies.select("id", "is_active", *[f"keep_last_{t.lower()}" for t in DATE_TYPES])
    limits = configs.select(
        F.col("id").alias(CONFIG), F.col("table_retention_policy_id").alias("policy_id")
    ).join(policy.withColumnRenamed("id", "policy_id"), "policy_id")
    newest_first = Window.partitionBy(CONFIG, "date_type").orderBy(F.desc("as_of_date"))
    rank = F.row_number().over(newest_first)
    kept = F.coalesce(rank <= keep_limit(F.col("date_type")), F.lit(False))
    return typed.join(limits.where("is_active"), CONFIG).select(
        CONFIG, "as_of_date", "date_type", kept.alias("kept")
    )


def keep_dates(typed: DataFrame, configs: DataFrame, policies: DataFrame) -> DataFrame:
    """The newest N dates of each type; a type without a limit keeps none."""
    return _ranked(typed, configs, policies).where("kept").drop("kept")


def candidate_dates(typed: DataFrame, configs: DataFrame, policies: DataFrame) -> DataFrame:
    """All other dates of tables with an active policy."""
    return _ranked(typed, configs, policies).where("NOT kept").drop("kept")


def typed_candidates(candidates: DataFrame, types: DataFrame) -> DataFrame:
    """Attach date types to bare candidate dates; a date without one counts as EOD."""
    return candidates.join(types, [CONFIG, "as_of_date"], "left").withColumn(
        "date_type", F.coalesce("date_type", F.lit("EOD"))
    )


def archive_decisions(
    candidates: DataFrame, configs: DataFrame, files: DataFrame, exemptions: DataFrame
) -> DataFrame:
    """Export or Skipped, with the reason, for each candidate of an active table."""
    key = [CONFIG, "as_of_date"]
    live = configs.where("is_active").select(F.col("id").alias(CONFIG))
    done = (
        files.where((F.col("status") == "Active") & F.col("as_of_date").isNotNull())
        .select(*key, "date_type").distinct().withColumn("archived", F.lit(True))
    )
    table_scope = exemptions.where(F.col("scope") == "Table")
    whole = (
        table_scope.where(F.col("as_of_date").isNull())
        .select(CONFIG).distinct().withColumn("exempt_table", F.lit(True))
    )
    single = (
        table_scope.where(F.col("as_of_date").isNotNull())
        .select(*key).distinct().withColumn("exempt_date", F.lit(True))
    )
    exempt = F.coalesce("exempt_table", "exempt_date", F.lit(False))
    message = F.when(F.col("archived"), MSG_ARCHIVED).when(exempt, MSG_EXEMPT)
    return (
        candidates.join(live, CONFIG, "left_semi")
        .join(done, [*key, "date_type"], "left")
        .join(whole, CONFIG, "left")
        .join(single, key, "left")
        .select(*key, "date_type", message.alias("message"))
        .withColumn("decision", F.when(F.col("message").isNull(), "Export").otherwise("Skipped"))
    )


def archive_plan(
    candidates: DataFrame, configs: DataFrame, files: DataFrame, exemptions: DataFrame
) -> DataFrame:
    """Candidate dates that are neither archived already nor exempt."""
    key = [CONFIG, "as_of_date"]
    exempt = exemptions.where(F.col("scope") == "Table")
    whole = exempt.where(F.col("as_of_date").isNull()).select(CONFIG)
    single = exempt.where(F.col("as_of_date").isNotNull()).select(*key)
    live = configs.where("is_active").select(F.col("id").alias(CONFIG))
    # Distinct before the join: a date has many files, and they combine on the map side.
    done = files.where(F.col("status") == "Active").select(*key, "date_type").distinct()
    return (
        candidates.join(live, CONFIG, "left_semi")
        .join(whole, CONFIG, "left_anti")
        .join(single, key, "left_anti")
        .join(done, [*key, "date_type"], "left_anti")
    )
