import datetime as dt

from conftest import as_rows
from pyspark.sql import functions as F

from granary import schemas
from granary.operators import retention

D = dt.date


def typed(spark, *days):
    df = spark.createDataFrame([(10, d) for d in days], f"{retention.CONFIG} int, as_of_date date")
    return retention.date_types(df)


def kinds(spark, *days):
    return {r["as_of_date"]: r["date_type"] for r in typed(spark, *days).collect()}


def test_last_available_date_of_a_closed_period(spark):
    assert kinds(spark, D(2020, 1, 30), D(2020, 2, 27), D(2020, 2, 28), D(2020, 3, 30), D(2020, 12, 30),
                 D(2021, 1, 4)) == {
        D(2020, 1, 30): "EOM", D(2020, 2, 27): "EOD", D(2020, 2, 28): "EOM", D(2020, 3, 30): "EOQ",
        D(2020, 12, 30): "EOY", D(2021, 1, 4): "EOD",
    }


def test_open_period_closes_on_its_last_calendar_day(spark):
    assert kinds(spark, D(2020, 6, 29)) == {D(2020, 6, 29): "EOD"}
    assert kinds(spark, D(2020, 5, 31)) == {D(2020, 5, 31): "EOM"}
    assert kinds(spark, D(2020, 6, 30)) == {D(2020, 6, 30): "EOQ"}
    assert kinds(spark, D(2020, 12, 31)) == {D(2020, 12, 31): "EOY"}


def test_null_dates_are_no_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 5),), (dt.datetime(2020, 1, 1, 9),), (None,)], "ts timestamp_ntz")
    assert as_rows(retention.as_of_dates(df, "ts")) == [(D(2020, 1, 1),)]


def test_keep_and_candidates_split_the_dates(spark):
    days = [D(2019, 1, 1) + dt.timedelta(days=i) for i in range(900)]
    t = typed(spark, *days)
    conf, pol = schemas.table_configurations(spark), schemas.retention_policies(spark)
    keep = as_rows(retention.keep_dates(t, conf, pol))
    cand = as_rows(retention.candidate_dates(t, conf, pol))
    assert len(keep) + len(cand) == 900 and not set(keep) & set(cand)
    newest_eod = sorted(r[1] for r in t.where("date_type = 'EOD'").select("*").collect())[-30:]
    assert sorted(r[1] for r in keep if r[2] == "EOD") == newest_eod


def test_null_limit_keeps_none(spark):
    t = typed(spark, D(2020, 1, 1), D(2020, 1, 2))
    conf = schemas.table_configurations(spark)
    pol = schemas.retention_policies(spark).withColumn("keep_last_eod", F.lit(None).cast("int"))
    assert retention.keep_dates(t, conf, pol).count() == 0
    assert retention.candidate_dates(t, conf, pol).count() == 2


def candidates(spark, rows):
    return spark.createDataFrame(rows, f"{retention.CONFIG} int, as_of_date date, date_type string")


def files(spark, rows):
    return spark.createDataFrame(
        rows, f"{retention.CONFIG} int, as_of_date date, date_type string, status string"
    )


def test_plan_skips_archived_and_exempt_dates(spark):
    d1, d2, d3, d4 = (D(2020, 1, i) for i in (1, 2, 3, 4))
    cand = candidates(spark, [(10, d, "EOD") for d in (d1, d2, d3, d4)] + [(30, d1, "EOD"), (50, d1, "EOD")])
    done = files(spark, [
        (10, d1, "EOD", "Active"), (10, d1, "EOD", "Active"), (10, d2, "EOM", "Active"),
        (10, d3, "EOD", "Created"), (10, None, "EOD", "Active"),
    ])
    exempt = spark.createDataFrame(
        [(1, 10, d4, "Table", ""), (2, 10, d2, "File", ""), (3, 30, None, "Table", "")], schemas.EXEMPTION
    )
    conf = schemas.table_configurations(spark)
    plan = as_rows(retention.archive_plan(cand, conf, done, exempt), "as_of_date")
    assert plan == [(10, d2, "EOD"), (10, d3, "EOD")]
    decided = retention.archive_decisions(cand, conf, done, exempt)
    assert as_rows(decided.where("decision = 'Export'").select(*decided.columns[:3]), "as_of_date") == plan
    reasons = {(r[0], r[1]): r[3] for r in decided.collect()}
    assert reasons[10, d1] == retention.MSG_ARCHIVED
    assert reasons[10, d4] == reasons[30, d1] == retention.MSG_EXEMPT
    assert (50, d1) not in reasons


def test_missing_type_counts_as_eod(spark):
    bare = candidates(spark, [(10, D(2020, 1, 1), "x")]).drop("date_type")
    types = candidates(spark, [(10, D(2020, 1, 2), "EOM")])
    assert as_rows(retention.typed_candidates(bare, types)) == [(10, D(2020, 1, 1), "EOD")]
