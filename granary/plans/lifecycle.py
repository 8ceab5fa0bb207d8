"""Lifecycle enforcement as an action table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from granary.operators.lifecycle import lifecycle_actions, lifecycle_summary
from granary.sinks.publish import publish_new


def enforce_lifecycle(
    files: DataFrame, configs: DataFrame, policies: DataFrame, run_ts: dt.datetime, account: str,
    out: str, container: str | None = None, dry_run: bool = False, page_size: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Actions of all due files and their counts per table and tier; unless a dry run, publish them.

    Whoever owns the store applies the published table; nothing is moved or deleted here.
    """
    actions = lifecycle_actions(files, configs, policies, run_ts, account, container, page_size)
    if not dry_run:
        spark = files.sparkSession
        publish_new(spark, out, lambda staged: actions.write.parquet(staged))
        actions = spark.read.parquet(out)
    return actions, lifecycle_summary(actions)
