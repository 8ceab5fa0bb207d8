"""Storage tier decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.schemas import THRESHOLD_PREFIX, TIER_ACTIONS

# The known tier names.
KNOWN_TIERS = ("Archive", "Cool", "Hot")


def normalise_tier(tier: Column) -> Column:
    """Known tier names in their canonical case; others pass through."""
    out = tier
    for name in KNOWN_TIERS:
        out = F.when(F.upper(tier) == name.upper(), name).otherwise(out)
    return out


def smallest_threshold(policy: str = "") -> Column:
    """Least of the fifteen day values, nulls skipped."""
    dot = f"{policy}." if policy else ""
    return F.least(
        *[F.col(f"{dot}{p}_{a}_days") for p in THRESHOLD_PREFIX.values() for a in TIER_ACTIONS]
    )


def threshold_for(action: str, date_type: Column, policy: str = "") -> Column:
    """The policy's day value for one action and the file's date type (null type = EOD)."""
    dot = f"{policy}." if policy else ""
    kind = F.coalesce(date_type, F.lit("EOD"))
    out = F.lit(None).cast("int")
    for name, prefix in THRESHOLD_PREFIX.items():
        out = F.when(kind == name, F.col(f"{dot}{prefix}_{action}_days")).otherwise(out)
    return out


def desired_tier(age_days: Column, date_type: Column, active: Column, policy: str = "") -> Column:
    """Deepest tier whose threshold the age has reached; null without an active policy."""
    reached = F.lit("Hot")
    for action in TIER_ACTIONS:
        reached = F.when(age_days >= threshold_for(action, date_type, policy), action.title()).otherwise(
            reached
        )
    return F.when(active, reached)
