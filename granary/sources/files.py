"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.paths import date_in_path
from granary.schemas import EXTERNAL_TYPE

CORRUPT = "_corrupt_record"

OBJECT_LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def scan_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed lines as ``value``; large files split into many tasks."""
    return spark.read.text(path)


def scan_typed_csv(
    spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST"
) -> DataFrame:
    """Header CSV with an explicit schema.

    FAILFAST aborts on a bad field; PERMISSIVE keeps such rows with their text in
    ``_corrupt_record``. Only fields that the query reads can be found bad.
    """
    if mode == "PERMISSIVE":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("mode", mode)
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False)
    return reader.csv(path)


def with_file_order(df: DataFrame, out: str = "seq") -> DataFrame:
    """Order of the rows in their files, for last-wins rules."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias(out))


def scan_untyped(spark: SparkSession, root: str, sheet: str | None = None, header: bool = True):
    """All-string table from a folder of CSV files, one sub-folder per sheet.

    Without a name the first sheet in name order is read; an unknown one is an error.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    sheets = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    if sheet is None:
        if not sheets:
            raise ValueError(f"no sheets in {root}")
        sheet = sheets[0]
    elif sheet not in sheets:
        raise ValueError(f"sheet {sheet} not found in {root}")
    return spark.read.option("header", header).option("inferSchema", False).csv(f"{root}/{sheet}")


def scan_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold a JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_json_lines_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold a JSON array written with one object to a line.

    Lines are objects, so large files are split between them as text is; brackets and separating commas are taken off. A line that
    does not fit the schema fails the read.
    """
    text = F.regexp_replace(F.trim("value"), r"^\[|[,\]]$", "")
    lines = spark.read.text(path).select(F.trim(text).alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def describe_objects(listing: DataFrame) -> DataFrame:
    """Path, size and times of listed objects, with the date found in their path.

    The content column is pruned, so objects are listed but never opened.
    """
    found = date_in_path(F.col("path"))
    return listing.select(
        "path", F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.md5(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))).alias("etag"),
        found.alias("as_of_date"),
        F.when(found.isNotNull(), EXTERNAL_TYPE).alias("date_type"),
    )


def scan_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """List the objects below ``root/prefix``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return describe_objects(reader.load(f"{root.rstrip('/')}/{prefix}"))
