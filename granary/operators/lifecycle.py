"""Age policies for archived files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.dates import cutoff, wall_clock
from granary.functions.tiers import desired_tier, normalise_tier, smallest_threshold
from granary.operators.retention import CONFIG
from granary.schemas import THRESHOLD_PREFIX, TIER_ACTIONS


def policy_thresholds(policies: DataFrame) -> DataFrame:
    """Long form: one row per policy, date type and action with its day value."""
    cells = [
        (kind, action, f"{prefix}_{action}_days")
        for kind, prefix in THRESHOLD_PREFIX.items()
        for action in TIER_ACTIONS
    ]
    stack = ", ".join(f"'{kind}', '{action}', {column}" for kind, action, column in cells)
    return policies.selectExpr(
        "id AS policy_id", "name", "azure_policy_tag", "is_active",
        f"stack({len(cells)}, {stack}) AS (date_type, action, days)",
    )


def policy_cutoffs(configs: DataFrame, policies: DataFrame, run_date: dt.date) -> DataFrame:
    """Smallest threshold per configuration and the date it reaches back to.

    The table's own policy counts if it is active and has a value, else all active ones
    together; configurations without any value have no candidates and drop out.
    """
    active = policies.where("is_active")
    overall = active.select(F.min(smallest_threshold())).scalar()
    own = active.select(
        F.col("id").alias("file_lifecycle_policy_id"), smallest_threshold().alias("own_days")
    )
    days = F.coalesce(F.col("own_days"), overall)
    return (
        configs.withColumnRenamed("id", CONFIG)
        .join(own, "file_lifecycle_policy_id", "left")
        .select(CONFIG, days.alias("min_days"))
        .where("min_days IS NOT NULL")
        .withColumn("cutoff_date", cutoff(F.lit(run_date), F.col("min_days")))
    )


def due_files(
    files: DataFrame, cutoffs: DataFrame, run_ts: dt.datetime, min_check_days: int = 1
) -> DataFrame:
    """All files that may be due: old enough, never checked, or not checked lately."""
    checked = F.col("last_tier_check_at_et")
    recheck = wall_clock(run_ts - dt.timedelta(days=min_check_days))
    age_date = F.coalesce("as_of_date", F.to_date("created_at_et"))
    due = (age_date <= F.col("cutoff_date")) | checked.isNull() | (checked <= recheck)
    return files.where(F.col("status") != "Deleted").join(cutoffs, CONFIG).where(due)


def lifecycle_candidates(
    files: DataFrame, cutoffs: DataFrame, run_ts: dt.datetime, page_size: int,
    min_check_days: int = 1, spread: int = 64,
) -> DataFrame:
    """The due files that come first per configuration, longest unchecked first, as one page.

    Only for callers that want a page; enforcement takes all due files. A configuration's
    files are ranked in ``spread`` shares first, so that only ``spread * page_size`` of them
    meet in one task.
    """
    order = [
        F.col("last_tier_check_at_et").asc_nulls_first(), F.col("as_of_date").asc_nulls_first(), F.col("id")
    ]
    share = F.pmod(F.xxhash64("id"), F.lit(spread))
    first = Window.partitionBy(CONFIG, share).orderBy(*order)
    page = Window.partitionBy(CONFIG).orderBy(*order)
    return (
        due_files(files, cutoffs, run_ts, min_check_days)
        .withColumn("_share_rank", F.row_number().over(first))
        .where(F.col("_share_rank") <= page_size)
        .withColumn("page_rank", F.row_number().over(page))
        .where(F.col("page_rank") <= page_size)
        .drop("_share_rank")
    )


def with_desired_tier(
    files: DataFrame, configs: DataFrame, policies: DataFrame, run_date: dt.date
) -> DataFrame:
    """Add the resolved policy, the age and the tier each file should be in.

    A file's override policy beats its table's; an inactive policy asks for nothing.
    """
    conf = configs.select(F.col("id").alias(CONFIG), "file_lifecycle_policy_id")
    policy = policies.withColumnRenamed("id", "policy_id").drop("name", "azure_policy_tag")
    resolved = F.coalesce("override_file_lifecycle_policy_id", "file_lifecycle_policy_id")
    age = F.date_diff(F.lit(run_date), F.coalesce("as_of_date", F.to_date("created_at_et")))
    return (
        files.join(conf, CONFIG, "left")
        .withColumn("policy_id", resolved)
        .join(policy.withColumnRenamed("is_active", "_active"), "policy_id", "left")
        .select(
            *files.columns, "policy_id", age.alias("age_days"),
            desired_tier(age, F.col("date_type"), F.col("_active")).alias("desired_tier"),
        )
    )


def configs_for_account(configs: DataFrame, account: str, container: str | None = None) -> DataFrame:
    """Active configurations of a storage account, its name in any case."""
    out = configs.where("is_active").where(
        F.upper("storage_account_name") == F.lit(account.upper())
    )
    return out if container is None else out.where(F.col("container_name") == container)


def lifecycle_actions(
    files: DataFrame, configs: DataFrame, policies: DataFrame, run_ts: dt.datetime,
    account: str, container: str | None = None, page_size: int | None = None,
) -> DataFrame:
    """Action table of one enforcement run over all tables of a storage account.

    All due files get their action; ``page_size`` limits a run to so many per table.
    """
    chosen = configs_for_account(configs, account, container)
    cutoffs = policy_cutoffs(chosen, policies, run_ts.date())
    due = (
        due_files(files, cutoffs, run_ts) if page_size is None
        else lifecycle_candidates(files, cutoffs, run_ts, page_size)
    )
    tier = F.col("desired_tier")
    # Fixed value: the wording of an action.
    action = F.format_string(
        "Table=%d File=%d Action=TierSet(%s)", F.col(CONFIG), F.col("id"),
        F.coalesce(tier, F.lit("none")),
    )
    return with_desired_tier(due.select(*files.columns), chosen, policies, run_ts.date()).select(
        CONFIG, F.col("id").alias("file_id"), "storage_account_name", "container_name",
        "blob_path", "age_days", normalise_tier(tier).alias("desired_tier"),
        action.alias("action"),
    )


def lifecycle_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy(CONFIG, "desired_tier").agg(F.count(F.lit(1)).alias("files"))


def file_full_view(
    files: DataFrame, configs: DataFrame, lifecycle: DataFrame, retention: DataFrame
) -> DataFrame:
    """Each file with its table configuration and both policies, in 38 columns."""
    shared = {"storage_account_name", "container_name"}
    f_renamed = {"id": "archival_file_id", "status": "file_status", "created_at_et": "file_created_at_et"}
    f_renamed |= {c: f"file_{c}" for c in shared}
    f_side = files.select(*[F.col(c).alias(f_renamed.get(c, c)) for c in files.columns])

    c_renamed = {"id": CONFIG, "is_active": "table_configuration_is_active"}
    c_renamed |= {c: f"config_{c}" for c in shared}
    c_side = configs.drop("delete_from_source").select(
        *[F.col(c).alias(c_renamed.get(c, c)) for c in configs.columns if c != "delete_from_source"]
    )
    p_side = lifecycle.select(
        F.col("id").alias("file_lifecycle_policy_id"),
        F.col("name").alias("file_lifecycle_policy_name"),
        F.col("azure_policy_tag").alias("file_lifecycle_azure_policy_tag"),
    )
    r_side = retention.select(
        F.col("id").alias("table_retention_policy_id"),
        F.col("name").alias("table_retention_policy_name"),
        F.col("is_active").alias("table_retention_policy_is_active"),
        *[c for c in retention.columns if c.startswith("keep_last_")],
    )
    return (
        f_side.join(c_side, CONFIG, "left")
        .join(p_side, "file_lifecycle_policy_id", "left")
        .join(r_side, "table_retention_policy_id", "left")
    )
