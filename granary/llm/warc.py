"""WARC archives of pages: written in segments with chunked framing, read back and reassembled.

A record's block is the HTTP response with chunked transfer encoding. A block longer than a
segment continues in ``continuation`` records that name the first record as their origin; the
last one gives the total length. Reading groups records by origin, orders them by segment
number, checks number and total length, and undoes the framing. A payload that another
page's record already holds is a ``revisit`` without body.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import shuffles_dropped

MIN_REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Bounds a file, which a reader takes into memory as a whole.
RECORDS_PER_FILE = 10_000
END = b"\r\n\r\n"
#: Fixed date: a page has none, and reruns write the same records.
DATE = "2000-01-01T00:00:00Z"


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``record_type``, ``refers_to`` per row of ``pages``.

    Of equal payloads of at least ``min_bytes`` the one with the largest page_id is the
    response and the others refer to it; every row with that page_id counts as the response.
    A null html is an empty payload. Rows whose page_id is null refer to a page that has one,
    and are responses if there is none. The largest page_id combines before the shuffle, and
    the lookup is a plain equi join whose hot digest adaptive execution splits.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= min_bytes
    origin = rows.where(long).groupBy("digest").agg(
        F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    key = F.when(long, F.col("digest"))
    return rows.withColumn("key", key).join(origin.withColumnRenamed("digest", "key"), "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("origin")).alias("refers_to"))


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}".replace("\r", " ").replace("\n", " ") for k, v in fields if v is not None]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + END


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None,
            unique: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page, each without the line ends that close it."""
    name = lambda i: f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{unique}|{page_id}|{digest}|{i}'.encode()).hexdigest())}>"
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        block = b"\r\n".join([*http, b"Content-Length: %d" % len(payload)]) + END
    else:
        block = b"\r\n".join([*http, b"Transfer-Encoding: chunked"]) + END + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    many = len(parts) > 1
    for i, part in enumerate(parts, 1):
        last = many and i == len(parts)
        yield _header([
            ("WARC-Type", kind if i == 1 else "continuation"), ("WARC-Record-ID", name(i)), ("WARC-Date", DATE),
            ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response" if i == 1 else None),
            ("WARC-Payload-Digest", f"sha1:{digest}" if i == 1 else None),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
            ("X-Page-ID", page_id if i == 1 else None), ("X-Refers-To-Page-ID", refers_to),
            ("WARC-Segment-Number", i if many else None), ("WARC-Segment-Origin-ID", name(1) if i > 1 else None),
            ("WARC-Segment-Total-Length", len(block) if last else None), ("Content-Length", len(part)),
        ]) + part


def write_warc(planned: DataFrame, path: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES) -> None:
    """Write the records of ``plan_records`` as gzip files below ``path``.

    Spark's text writer puts the closing line ends after each record, so files appear whole
    or not at all, in whatever store the folder is. Values are bytes, not text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                page = [batch.column(k)[i].as_py() for k in range(batch.num_columns)]
                made += records(*page, f"{task}.{row}", segment, chunk)
                row += 1
                if len(made) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                    made = []
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    made = planned.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "record binary")
    with shuffles_dropped(planned.sparkSession):
        made.select(F.col("record").cast("string")).write.options(
            lineSep=END.decode(), compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or stream.read(len(END)) != END:
            raise ValueError("a record does not end where its length says")
        yield fields, block


SEGMENT = "origin string, page_id long, url string, kind string, refers_to long, digest string, total long, no int, block binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def number(fields: dict[str, str], key: str) -> int | None:
        return int(fields[key]) if key in fields else None

    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                first = f["warc-type"] != "continuation"
                rows.append((
                    f["warc-record-id"] if first else f["warc-segment-origin-id"], number(f, "x-page-id"),
                    f.get("warc-target-uri") if first else None, f["warc-type"] if first else None, number(f, "x-refers-to-page-id"),
                    f["warc-payload-digest"].removeprefix("sha1:") if first else None,
                    number(f, "warc-segment-total-length"), int(f.get("warc-segment-number", 1)), block,
                ))
                if len(rows) >= 512:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Pages of the archives below ``path``, continuations joined; ``payload`` is null for revisits
    and where ``payloads`` is off. A missing, surplus or cut-off segment, a wrong total length, bad
    framing or a payload that differs from its digest fails the read. An archive without
    records gives no rows.
    """
    names = [f.split()[0] for f in PAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["no"])
                block = b"".join(p["block"] for p in parts)
                if [p["no"] for p in parts] != list(range(1, len(parts) + 1)) or r["total"] != (len(block) if len(parts) > 1 else None):
                    raise ValueError(f"segments of {r['origin']} do not add up")
                head, _, body = block.partition(END)
                payload = None
                if r["kind"] == "revisit":
                    sizes = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    size = int(sizes[0])
                else:
                    payload = dechunked(body)
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != r["digest"]:
                        raise ValueError(f"payload of {r['origin']} differs from its digest")
                rows.append((r["page_id"], r["url"], size, r["digest"], r["kind"], r["refers_to"], payload if payloads else None))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    one = files.mapInArrow(_segments, SEGMENT).groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("page_id", "url", "kind", "refers_to", "digest", "total")],
        F.collect_list(F.struct("no", "block")).alias("parts"))
    return one.mapInArrow(run, PAGE)
