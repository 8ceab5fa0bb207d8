"""Objects that other systems drop into a folder, registered as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granary.operators.archive import as_archival_files, upsert_files
from granary.operators.retention import CONFIG
from granary.schemas import ARCHIVAL_FILE
from granary.sinks.file_table import FileTable
from granary.sinks.snapshots import Version
from granary.sources.files import OBJECT_LISTING, describe_objects


def discovered_files(listing: DataFrame, config_id: int) -> DataFrame:
    """archival_file rows of listed objects, dated by their path."""
    found = describe_objects(listing).withColumn(CONFIG, F.lit(config_id)).withColumns({
        "blob_path": F.col("path"),
        "status": F.lit("Active"),
        "content_type": F.lit("application/octet-stream"),
        "created_at_et": F.col("modified_at"),
    })
    return as_archival_files(found)


def stream_discovery(
    spark: SparkSession, root: str, config_id: int, out: str, checkpoint: str
) -> StreamingQuery:
    """Register the objects that are new below ``root``, then stop."""
    listing = (
        spark.readStream.format("binaryFile").schema(OBJECT_LISTING)
        .option("recursiveFileLookup", True).load(root)
    )

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # Columns chosen before the sink prune the content, so that no object is opened.
    writer = discovered_files(listing, config_id).writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_files(spark: SparkSession, existing: DataFrame, out: str) -> DataFrame:
    """Existing archival files with all discovered ones merged in, newest row first."""
    found = spark.read.schema(ARCHIVAL_FILE).parquet(out).select(*ARCHIVAL_FILE.names)
    return upsert_files(existing, found, "created_at_et")


#: Value of a file table that numbers the discoveries merged into it.
DISCOVERED = "discovery"


def changed_objects(listing: DataFrame, known: DataFrame, config_id: int) -> DataFrame:
    """File rows of listed objects that ``known`` does not have or has with another etag."""
    found = discovered_files(listing, config_id)
    same = known.where(F.col(CONFIG) == config_id).select("blob_path", "etag")
    return found.join(same, ["blob_path", "etag"], "left_anti").select(*ARCHIVAL_FILE.names)


def refresh_files(spark: SparkSession, root: str, config_id: int, table: FileTable) -> Version:
    """Bring a file table up to the objects below ``root``: new ones are inserted, changed ones update their row.

    A listing is compared with the table by path and etag, so an object that was written again is noticed, and a listing
    without changes adds no version.
    """
    listing = spark.read.format("binaryFile").schema(OBJECT_LISTING).option("recursiveFileLookup", True).load(root)
    rows = changed_objects(listing, table.read(), config_id)
    return table.store.version() if rows.isEmpty() else table.merge(rows)


def stream_upsert(
    spark: SparkSession, root: str, config_id: int, table: FileTable, checkpoint: str
) -> StreamingQuery:
    """Merge the objects that are new below ``root`` into a file table, then stop.

    A batch is merged under its number and only once: one that runs again after a failure finds its number in the table.
    The file source remembers paths, so objects that were written again are left to :func:`refresh_files`.
    """
    listing = (
        spark.readStream.format("binaryFile").schema(OBJECT_LISTING)
        .option("recursiveFileLookup", True).load(root)
    )

    def merge(rows: DataFrame, batch_id: int) -> None:
        table.merge(rows, done={f"{DISCOVERED}_{config_id}": batch_id})

    writer = discovered_files(listing, config_id).writeStream.foreachBatch(merge)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
