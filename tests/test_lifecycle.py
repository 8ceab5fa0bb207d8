import datetime as dt

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from granary import schemas
from granary.functions.tiers import normalise_tier
from granary.operators import lifecycle
from granary.operators.retention import CONFIG

D = dt.date
NOW = dt.datetime(2020, 6, 30)


def files(spark, *rows):
    names = ["id", CONFIG, "as_of_date", "date_type", "status", "created_at_et", "last_tier_check_at_et",
             "override_file_lifecycle_policy_id"]
    whole = [tuple(dict(zip(names, row)).get(f.name) for f in schemas.ARCHIVAL_FILE) for row in rows]
    return spark.createDataFrame(whole, schemas.ARCHIVAL_FILE)


def tier(spark, config, day, kind, override=None, policies=None, created=NOW):
    f = files(spark, (1, config, day, kind, "Active", created, None, override))
    policies = policies or schemas.lifecycle_policies(spark)
    return lifecycle.with_desired_tier(f, schemas.table_configurations(spark), policies, NOW.date()).first()["desired_tier"]


@pytest.mark.parametrize("age, expected", [(0, "Hot"), (6, "Hot"), (7, "Cool"), (29, "Cool"), (30, "Archive"), (364, "Archive"), (365, "Delete"), (-3, "Hot")])
def test_thresholds_are_inclusive(spark, age, expected):
    assert tier(spark, 10, NOW.date() - dt.timedelta(days=age), "EOD") == expected


def test_type_defaults_and_external(spark):
    day = NOW.date() - dt.timedelta(days=3)
    assert tier(spark, 10, day, None) == "Hot"
    assert tier(spark, 10, day, "EXT") == "Cool"


def test_zero_is_a_threshold(spark):
    assert tier(spark, 10, NOW.date(), "EOD", override=2) == "Cool"
    assert tier(spark, 20, NOW.date(), "EOD") == "Delete"


def test_override_beats_table_policy(spark):
    day = NOW.date() - dt.timedelta(days=20)
    assert tier(spark, 10, day, "EOD") == "Cool"
    assert tier(spark, 10, day, "EOD", override=4) == "Hot"


def test_age_falls_back_to_creation(spark):
    assert tier(spark, 10, None, "EOD", created=dt.datetime(2020, 6, 1, 23)) == "Cool"


def test_inactive_policy_asks_for_nothing(spark):
    off = schemas.lifecycle_policies(spark).withColumn("is_active", F.lit(False))
    assert tier(spark, 10, D(2000, 1, 1), "EOD", policies=off) is None


def test_null_threshold_is_skipped(spark):
    pol = schemas.lifecycle_policies(spark).withColumn("eod_archive_days", F.lit(None).cast("int"))
    assert tier(spark, 10, NOW.date() - dt.timedelta(days=100), "EOD", policies=pol) == "Cool"


def test_cutoffs(spark):
    pol = schemas.lifecycle_policies(spark)
    conf = schemas.table_configurations(spark)
    got = {r[0]: r[1] for r in lifecycle.policy_cutoffs(conf, pol, NOW.date()).collect()}
    assert got == {10: 3, 20: 0, 30: 7, 40: 0}
    # An inactive own policy falls back to all active ones.
    pol2 = pol.withColumn("is_active", ~F.col("id").isin(1, 2, 3))
    got = {r[0]: r[1] for r in lifecycle.policy_cutoffs(conf, pol2, NOW.date()).collect()}
    assert got == {10: 7, 20: 7, 30: 7, 40: 7}
    none = pol.withColumn("is_active", F.lit(False))
    assert lifecycle.policy_cutoffs(conf, none, NOW.date()).count() == 0


def test_candidates_and_page(spark):
    old, new = D(2020, 1, 1), D(2020, 6, 29)
    recent = NOW - dt.timedelta(hours=2)
    f = files(
        spark,
        (1, 10, old, "EOD", "Active", NOW, recent, None),     # old enough
        (2, 10, new, "EOD", "Active", NOW, recent, None),     # too new, just checked
        (3, 10, new, "EOD", "Active", NOW, None, None),       # never checked
        (4, 10, new, "EOD", "Active", NOW, NOW - dt.timedelta(days=1), None),
        (5, 10, None, "EOD", "Active", NOW, recent, None),    # no date, created today
        (6, 10, None, "EOD", "Active", dt.datetime(2020, 1, 1), recent, None),
        (7, 10, old, "EOD", "Deleted", NOW, None, None),
    )
    cut = lifecycle.policy_cutoffs(schemas.table_configurations(spark), schemas.lifecycle_policies(spark), NOW.date())
    for spread in (1, 3, 64):
        page = lifecycle.lifecycle_candidates(f, cut, NOW, page_size=4, spread=spread)
        assert as_rows(page.select("page_rank", "id"), "page_rank") == [(1, 3), (2, 4), (3, 6), (4, 1)]


def test_tier_names(spark):
    df = spark.createDataFrame([(x,) for x in ("hot", "COOL", "aRchive", "Cold", None)], "t string")
    assert [r[0] for r in df.select(normalise_tier(F.col("t"))).collect()] == ["Hot", "Cool", "Archive", "Cold", None]


def test_account_filter(spark):
    conf = schemas.table_configurations(spark)
    assert as_rows(lifecycle.configs_for_account(conf, "DevStore").select("id"), "id") == [(10,), (20,), (30,)]
    assert as_rows(lifecycle.configs_for_account(conf, "devstore", "external").select("id")) == [(20,)]


def test_recheck_time_ignores_the_session_zone(spark):
    edge = NOW - dt.timedelta(days=1)
    f = files(
        spark, (1, 10, D(2020, 6, 29), "EOD", "Active", NOW, edge, None),
        (2, 10, D(2020, 6, 29), "EOD", "Active", NOW, edge + dt.timedelta(seconds=1), None),
    )
    cut = lifecycle.policy_cutoffs(schemas.table_configurations(spark), schemas.lifecycle_policies(spark), NOW.date())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert as_rows(lifecycle.due_files(f, cut, NOW).select("id")) == [(1,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_every_due_file_gets_an_action(spark):
    n = 12_000
    f = spark.range(n).selectExpr("id").join(
        files(spark, (0, 10, D(2019, 1, 1), "EOD", "Active", NOW, None, None)).drop("id"), how="cross"
    )
    conf, pol = schemas.table_configurations(spark), schemas.lifecycle_policies(spark)
    assert lifecycle.lifecycle_actions(f, conf, pol, NOW, "devstore").count() == n
    assert lifecycle.lifecycle_actions(f, conf, pol, NOW, "devstore", page_size=7).count() == 7
