"""Fixed schemas, import templates and seed rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# ---------------------------------------------------------------- fixed values
# Enumerations of the archival data model.
DATE_TYPES = ("EOD", "EOM", "EOQ", "EOY")
EXTERNAL_TYPE = "EXT"
THRESHOLD_PREFIX = {"EOD": "eod", "EOM": "eom", "EOQ": "eoq", "EOY": "eoy", "EXT": "external"}
TIER_ACTIONS = ("cool", "archive", "delete")

# Feed record type -> (table, number of columns).
FEED_ROUTES = {
    "06": ("product", 5),
    "07": ("inventory", 4),
    "09": ("trade", 3),
    "12": ("deals", 6),
}

# Writer defaults.
ROWS_PER_PART = 50_000
ROW_GROUP_BYTES = 8 * 1024**2
ROW_GROUP_ROWS = 8_192
JDBC_BATCH_ROWS = 1_000

# Import templates: name -> ordered (column, type).
TEMPLATES = {
    "Template1": T.StructType([
        T.StructField("FundId", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Return", T.DoubleType()),
    ]),
    "Template2": T.StructType([
        T.StructField("ColumnA", T.StringType()),
        T.StructField("ColumnB", T.IntegerType()),
    ]),
}

def template(name: str) -> T.StructType:
    if name not in TEMPLATES:
        raise ValueError(f"template '{name}' is not defined")
    return TEMPLATES[name]


# Twelve required numbers and one required text of the metric form.
METRIC_NUMBERS = (
    "clientEscalationsKyc",
    "supplierEscalationsSourcing",
    "gAndEPreclearanceRequests",
    "fspEscalationsKyc",
    "offerOfEmploymentEscalationsHr",
    "spEscalationsOutsideSpeakers",
    "eCommunicationEscalationsCommsSurveillance",
    "obaPiCentralCompliance",
    "gAndEExpensesDfin",
    "gAndEExpenseAnomalies",
    "agedGeReconciliations",
    "supplierEscalationsTprm",
)
METRIC_TEXT = "descriptionUpdate"
# ------------------------------------------------------------------------------

FILE_A = T.StructType([
    T.StructField("DealId", T.StringType()),
    T.StructField("TradeId", T.StringType()),
    T.StructField("BookCode", T.StringType()),
    T.StructField("Tsip", T.StringType()),
    T.StructField("ProviderId", T.StringType()),
    T.StructField("TradeDate", T.DateType()),
    T.StructField("BusinessDate", T.DateType()),
    T.StructField("SettlementDate", T.DateType()),
    T.StructField("BuyPrice", T.DecimalType(18, 2)),
])

FILE_B = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("TradeId", "Category", "IndicatorType", "IndicatorSubTypeCode", "MeasureValue")
])

METRIC_FORM = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in METRIC_NUMBERS]
    + [T.StructField(METRIC_TEXT, T.StringType())]
)

RETENTION_POLICY = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("is_active", T.BooleanType(), False),
    ]
    + [T.StructField(f"keep_last_{t.lower()}", T.IntegerType()) for t in DATE_TYPES]
)

THRESHOLD_COLUMNS = [
    f"{prefix}_{action}_days" for prefix in THRESHOLD_PREFIX.values() for action in TIER_ACTIONS
]

LIFECYCLE_POLICY = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("is_active", T.BooleanType(), False),
        T.StructField("azure_policy_tag", T.StringType()),
    ]
    + [T.StructField(name, T.IntegerType()) for name in THRESHOLD_COLUMNS]
)

TABLE_CONFIGURATION = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("database_name", T.StringType(), False),
    T.StructField("schema_name", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("as_of_date_column", T.StringType()),
    T.StructField("export_mode", T.StringType(), False),
    T.StructField("storage_account_name", T.StringType(), False),
    T.StructField("container_name", T.StringType(), False),
    T.StructField("archive_path_template", T.StringType(), False),
    T.StructField("discovery_path_prefix", T.StringType()),
    T.StructField("table_retention_policy_id", T.IntegerType()),
    T.StructField("file_lifecycle_policy_id", T.IntegerType()),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("delete_from_source", T.BooleanType(), False),
])

ARCHIVAL_FILE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("table_configuration_id", T.IntegerType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("date_type", T.StringType()),
    T.StructField("storage_account_name", T.StringType()),
    T.StructField("container_name", T.StringType()),
    T.StructField("blob_path", T.StringType()),
    T.StructField("etag", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at_et", T.TimestampNTZType()),
    T.StructField("archival_policy_tag", T.StringType()),
    T.StructField("current_access_tier", T.StringType()),
    T.StructField("last_tier_check_at_et", T.TimestampNTZType()),
    T.StructField("override_file_lifecycle_policy_id", T.IntegerType()),
    T.StructField("last_tags_sync_at_et", T.TimestampNTZType()),
])

EXEMPTION = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("table_configuration_id", T.IntegerType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("scope", T.StringType()),
    T.StructField("reason", T.StringType()),
])

RUN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("started_at_et", T.TimestampNTZType()),
    T.StructField("ended_at_et", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("note", T.StringType()),
])

DELETE_COUNTS = T.StructType([
    T.StructField("table_configuration_id", T.IntegerType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("expected_rows", T.LongType()),
    T.StructField("actual_rows", T.LongType()),
])

RUN_DETAIL = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("table_configuration_id", T.IntegerType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("date_type", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows_affected", T.LongType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

# ----------------------------------------------------- fixed values: seed rows
RETENTION_SEED = [
    (1, "Default Retention", True, 30, 12, 8, 3),
    (2, "Long Term Retention", True, 365, 60, 24, 10),
    (3, "Regulatory Audit Retention (10y)", True, 3650, 3650, 3650, 3650),
]

# id, name, active, tag, then cool/archive/delete days for EOD, EOM, EOQ, EOY, external.
LIFECYCLE_SEED = [
    (1, "Default File Policy", True, "default-policy",
     7, 30, 365, 7, 60, 3650, 14, 90, 3650, 30, 180, 3650, 3, 30, 365),
    (2, "Cold Archive Policy", True, "cold-policy",
     0, 7, 365, 0, 30, 3650, 0, 60, 3650, 0, 180, 3650, 0, 30, 365),
    (3, "External Files Policy", True, "external-policy",
     0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 30, 365),
    (4, "Regulatory File Policy", True, "regulatory-policy",
     30, 365, 3650, 30, 365, 3650, 30, 365, 3650, 30, 365, 3650, 7, 90, 3650),
]

_TEMPLATE = "/{db}/{schema}/{table}/{yyyy}/{MM}/{dd}"
CONFIGURATION_SEED = [
    (10, "TestDb", "dbo", "transactions", "as_of_date", "SelfManaged",
     "devstore", "archival", _TEMPLATE, None, 1, 1, True, True),
    (20, "TestDb", "dbo", "external_reports", None, "External",
     "devstore", "external", "external" + _TEMPLATE, "external/", 2, 3, True, False),
    (30, "TestDb", "dbo", "financial_audit", "as_of_date", "SelfManaged",
     "devstore", "audit-archive", _TEMPLATE, None, 3, 4, True, False),
    (40, "TestDb", "dbo", "allocationsummary_external", None, "External",
     "myStorageAccount", "app", _TEMPLATE,
     "file-output/modules/sgas/15c3-3/output/allocationsummary/2023-08-31/", 2, 3, True, False),
]
# ------------------------------------------------------------------------------


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table whose size the optimizer knows.

    Built from Arrow it becomes a local relation, so a join broadcasts it for being small
    and not for being hinted, and never shuffles the large side by a handful of ids.
    """
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def retention_policies(spark: SparkSession) -> DataFrame:
    return local_table(spark, RETENTION_SEED, RETENTION_POLICY)


def lifecycle_policies(spark: SparkSession) -> DataFrame:
    return local_table(spark, LIFECYCLE_SEED, LIFECYCLE_POLICY)


def table_configurations(spark: SparkSession) -> DataFrame:
    return local_table(spark, CONFIGURATION_SEED, TABLE_CONFIGURATION)
