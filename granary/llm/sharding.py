"""Sharding by fixed virtual slots.

Records are hashed into SLOTS slots, whose number never changes. A map says which shard each slot belongs to; it is a small
table with a version, and rebalancing writes the next version from the bytes in each slot: a shard above its
share gives up its lightest slots, heaviest first goes each of them to the shard that holds least. All other slots, and so
the records in them, stay where they are. DataFrame operations only.

A slot that holds many times a slot's share, in rows or bytes, is cut into parts, which the map places one by
one. Equal records share all hashes; only where they alone make a slot hot are their copies dealt in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize
from granary.operators.numbering import number_rows
from granary.session import shared_dir

#: A slot is named by this many leading hex digits of a record's digest.
SLOT_DIGITS = 3
SLOTS = 16**SLOT_DIGITS
SHARDS = 24
#: A slot is hot from 1 / HOT of all rows or bytes, so there are at most 2 HOT hot slots and 4 HOT parts of them.
HOT = 200
#: Bytes that a record takes beside its text.
RECORD_BYTES = 8


def records(docs: DataFrame) -> DataFrame:
    """``row_id``, ``doc_id``, ``size``, ``text_crc32``, ``digest``, ``virtual_slot`` of each row, written once without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    made = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    return materialize(made.withColumn("digest", digest).withColumn("virtual_slot", _digits(1, SLOT_DIGITS).cast("int")), "shard-records")


def _digits(start: int, n: int) -> Column:
    return F.conv(F.substring("digest", start, n), 16, 10).cast("long")


def with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``part`` of their slot, 0 in slots of ordinary size, and whether equal records make it hot (``heavy``).

    The lists of hot slots and of hot digests have at most 2 HOT rows, as each stands for 1 / HOT of all rows or bytes.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")]
    slots = materialize(rows.groupBy("virtual_slot").agg(*sums), "shard-slots")
    total = slots.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("all_bytes"))
    shares = F.greatest(F.col("n") * HOT / F.col("all_n"), F.col("bytes") * HOT / F.col("all_bytes"))
    hot = slots.crossJoin(F.broadcast(total)).where(shares > 1).select("virtual_slot", F.ceil(shares).alias("parts"), "all_n", "all_bytes")
    inside = rows.join(F.broadcast(hot), "virtual_slot")
    heavy = inside.groupBy("virtual_slot", "digest").agg(*sums, F.first("all_n").alias("all_n"), F.first("all_bytes").alias("all_bytes"))
    heavy = heavy.where((F.col("n") > 1) & (shares > 1)).select("digest", F.lit(True).alias("heavy"))
    marked = rows.join(F.broadcast(hot.select("virtual_slot", "parts")), "virtual_slot", "left").join(
        F.broadcast(heavy), "digest", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    # Copies of a heavy record are dealt in turn, so each part has the same number of them however they are read.
    copies = number_rows(marked.where("heavy"), ["digest"], [F.col("row_id")], F.shiftright("row_id", 20), "copy")
    light = marked.where("not heavy").withColumn("copy", _digits(SLOT_DIGITS + 1, 8))
    return light.unionByName(copies).withColumn(
        "part", F.coalesce(F.pmod("copy", F.col("parts")), F.lit(0)).cast("int")).drop("parts", "copy")


def first_map(units: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: slots and parts dealt in turn. ``units`` has ``virtual_slot`` and ``part``."""
    return units.select(
        "virtual_slot", "part", F.pmod(F.col("virtual_slot") + F.col("part"), F.lit(shards)).cast("int").alias("shard"))


def rebalanced(current: DataFrame, units: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: the edits that bring all shards near an equal share of the bytes.

    ``units`` has ``bytes`` per slot and part; one that ``current`` lacks starts in its place of version 1. Each shard keeps its
    heaviest slots up to its share; the lighter ones beyond it are placed anew, heaviest first, each in the
    shard with the fewest bytes (the lowest of equal ones). A new shard starts out empty, so it takes what the old ones give up.
    All tables here have a row per slot, whatever the number of records.
    """
    key = ["virtual_slot", "part"]
    at = units.join(current.select(*key, "shard"), key, "left").select(
        *key, "bytes", F.coalesce("shard", F.pmod(F.col("virtual_slot") + F.col("part"), F.lit(shards)).cast("int")).alias("shard"))
    filled = Window.partitionBy("shard").orderBy(F.desc("bytes"), *key)
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    marked = at.withColumn("released", F.sum("bytes").over(filled) > share)
    item = F.struct((-F.col("bytes")).alias("minus"), *key)
    # One row: the released slots in order of size, and the bytes that each shard keeps.
    kept = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("held", lambda h: h.shard == s), F.lit(0).cast("long"), lambda x, h: x + h.bytes))
    one = marked.agg(
        F.array_sort(F.collect_list(F.when(F.col("released"), item))).alias("items"),
        F.collect_list(F.when(~F.col("released"), F.struct("shard", "bytes"))).alias("held"),
    ).select("items", kept.alias("loads"))
    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))

    def place(state: Column, x: Column) -> Column:
        least = (F.array_position(state.loads, F.array_min(state.loads)) - 1).cast("int")
        loads = F.transform(state.loads, lambda v, i: F.when(i == least, v - x.minus).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(state.to, F.array(least)).alias("to"))

    placed = one.select("items", F.aggregate("items", start, place).to.alias("to")).select(
        F.explode(F.arrays_zip("items", "to")).alias("x")).select("x.items.virtual_slot", "x.items.part", F.col("x.to").alias("new"))
    return marked.join(placed, key, "left").select(
        *key, F.coalesce("new", "shard").alias("shard"))


def write_map(made: DataFrame, path: str, version: int) -> DataFrame:
    """Add a version to a stored map and read it back; a version that is there already is an error."""
    made.write.parquet(f"{path}/version={version}")
    return made.sparkSession.read.schema(made.schema).parquet(f"{path}/version={version}")


def assign(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``virtual_slot``, ``part``, ``shard`` and ``place`` (from 0, gapless in the shard) of each row.

    ``path`` is where the map's two versions are stored: slots in turn, then balanced by bytes. Null texts are empty, a null doc_id is
    hashed as an empty one, other columns are not read; equal rows are told apart by where they are read. No rows give no
    rows. Places follow slot, part and digest; groups of any size are numbered slice by slice.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shard-map")
    rows = materialize(with_parts(records(docs)), "shard-parts")
    units = materialize(rows.groupBy("virtual_slot", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-units")
    first = write_map(first_map(units, shards), path, 1)
    last = write_map(rebalanced(first, units, shards), path, 2)
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = units.join(last, ["virtual_slot", "part"]).select(
        "virtual_slot", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # At most SLOTS + 4 HOT rows.
    prefix = F.substring("digest", 1, SLOT_DIGITS + 4)
    block = F.when(F.col("heavy"), F.struct("digest", F.shiftright("row_id", 20).alias("block")))
    numbered = number_rows(
        rows, ["virtual_slot", "part"], [prefix, F.col("heavy"), F.col("digest"), F.col("row_id")],
        F.struct(prefix.alias("prefix"), "heavy", block.alias("block")), "row_no")
    return numbered.join(F.broadcast(starts), ["virtual_slot", "part"]).select(
        "doc_id", "size", "text_crc32", "virtual_slot", "part", "shard", (F.col("start") + F.col("row_no") - 1).alias("place"))
