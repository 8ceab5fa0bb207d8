"""Feed files routed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from granary.operators.feed import Routes, routed_rows
from granary.schemas import FEED_ROUTES

#: Files of one micro-batch; a backlog becomes several.
FILES_PER_BATCH = 1000


def stream_feed(
    spark: SparkSession, source: str, out: str, checkpoint: str, tee: str | None = None,
    routes: Routes = FEED_ROUTES, empty_as_null: bool = False,
    clean_to: str | None = None, files_per_batch: int = FILES_PER_BATCH,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Ingest the files that are new since the last run, then stop.

    Each micro-batch overwrites its own ``batch_id=`` folder, so a batch that runs again
    after a failure leaves the same rows. ``tee`` keeps a gzip copy of the lines;
    ``clean_to`` moves inputs away once a later batch has run; ``on_batch`` is called with
    the lines of each batch.
    """
    def write(lines: DataFrame, batch: int) -> None:
        # Each output reads the batch's files again; keeping them would spill a large batch.
        if tee is not None:
            text = lines.select("value").write.mode("overwrite").option("compression", "gzip")
            text.text(f"{tee}/batch_id={batch}")
        routed = routed_rows(lines, routes, empty_as_null).write.mode("overwrite")
        routed.partitionBy("table_name").parquet(f"{out}/batch_id={batch}")
        if on_batch is not None:
            on_batch(lines, batch)

    reader = spark.readStream.format("text")
    if clean_to is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", clean_to)
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.load(source).writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
