"""Small helpers of the package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import shared_dir
from granary.sinks.publish import remove

#: Words: runs without space and 0x09-0x0D. Fixed value; Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and what later
    steps read is the same rows however often a task runs."""
    path = shared_dir(df.sparkSession, label)
    for made in _open:
        made.append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Lists of the folders written within each open :func:`scratch`.
_open: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write within removes its shuffle files when it ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the folders that :func:`materialize` writes within, for :func:`drop` once their last reader has been written."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open[:] = [m for m in _open if m is not made]


def drop(spark: SparkSession, *made: str | DataFrame) -> None:
    """Remove folders of materialized tables, given by path or as the table; nothing may read them any more."""
    for one in made:
        for folder in [one] if isinstance(one, str) else {unquote(f.rpartition("/")[0]) for f in one.inputFiles()}:
            remove(spark, folder)


#: Largest side of a join that is sent to all executors.
BROADCAST_BYTES = 32 << 20


def sent_if_small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, a written table, for the small side of a join: broadcast if the sum of ``row_bytes`` over
    its rows fits the bound, and joined by a shuffle otherwise."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _placed(docs: DataFrame) -> DataFrame | None:
    """As :func:`by_place`, or none if ``docs`` are not all rows of files, each once."""
    try:
        at = docs.metadataColumn("_metadata")
        name, place = at["file_path"].alias("name"), at["row_index"].alias("place")
        rows = docs.select(name, place, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        files = docs.select(name, place).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).collect()
    except AnalysisException:
        return None
    if any(r["n"] != r["last"] + 1 for r in files):
        return None
    numbers = [(r["name"], i) for i, r in enumerate(sorted(files, key=lambda r: r["name"]))]
    named = docs.sparkSession.createDataFrame(numbers, "name string, file long")
    return rows.join(F.broadcast(named), "name").select((F.shiftleft("file", PLACE_BITS) + F.col("place")).alias("row_id"), "row")


def by_place(docs: DataFrame, label: str) -> DataFrame:
    """``row_id`` and ``row``, all columns, of ``docs``. A row's number is its place in the files that ``docs`` is read from, ordered by
    name, the same whenever it is read, so that no copy is written; rows from elsewhere are written first. The driver gets the files' names."""
    found = _placed(docs)
    return _placed(materialize(docs, label)) if found is None else found


#: Bits of a row's place in its file, and of its place in a list of :func:`listed`.
PLACE_BITS, LIST_BITS = 40, 14


def listed(counts: DataFrame) -> DataFrame:
    """``chunk`` and ``counts``, a byte per row in order, of ``row_id``, ``n`` of all rows of :func:`by_place`."""
    place = F.col("row_id").bitwiseAND(F.lit((1 << LIST_BITS) - 1))
    return counts.select(F.shiftright("row_id", LIST_BITS).alias("chunk"), F.struct(place.alias("place"), F.col("n").cast("byte").alias("n")).alias("r")).groupBy(
        "chunk").agg(F.sort_array(F.collect_list("r")).alias("r")).select("chunk", F.col("r.n").alias("counts"))


def counted_rows(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` of :func:`by_place` with ``n`` from ``lists``, a written table of :func:`listed`, where it is above 0. A byte a row is sent
    to all executors, or joined by a shuffle where these are too many."""
    place = F.col("row_id").bitwiseAND(F.lit((1 << LIST_BITS) - 1))
    return rows.withColumn("chunk", F.shiftright("row_id", LIST_BITS)).join(
        sent_if_small(lists, F.size("counts") * 9 / 8 + 64), "chunk").select(
        "row", F.get("counts", place.cast("int")).cast("long").alias("n")).where("n > 0")
