"""Removal of byte strings that occur more than once, by suffix arrays over shards.

1. Every 200-byte window is assigned to its anchor, the 64-byte string in it with the smallest hash.
   Equal windows have equal anchors, so only documents that share one can share a window.
   Consecutive windows of a document with one anchor form a context; contexts that occur twice as
   a whole are repeated without further work.
2. Contexts that share their anchor with a different one are brought together by anchor. The
   bytes of a shard are sorted by induced sorting; common prefixes of neighbours in the
   suffix array tell which windows start elsewhere too.
3. An anchor with very many contexts is dealt over several shards, each with its own array; what an
   array holds once is then matched between them by the hash of the window.
4. Each document's repeated windows are united and their bytes removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import bytes_np as B
from granary.llm.common import materialize
from granary.llm.suffix_array import neighbours, permuted_lcp, suffix_array

LENGTH = 200
ANCHOR_BYTES = 64
#: Windows of a text looked at together; limits memory for very long texts.
SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: Contexts of one anchor in one shard, and bytes sorted in one array.
SHARD_CONTEXTS, ARRAY_BYTES = 1024, 1 << 20
#: Text after which a task combines the contexts it has seen.
COMBINE_BYTES = 64 << 20


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = x.size
    y = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def contexts(text: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR_BYTES) -> tuple[np.ndarray, ...]:
    """``anchor``, ``content`` (hashes), ``start`` and ``count`` of the runs of windows with one anchor."""
    parts = []
    for at in range(0, max(text.size - length + 1, 0), SEGMENT):
        own = text[at : at + SEGMENT + length - 1]
        sums = B.prefix_sums(own)
        place = np.arange(own.size - anchor + 1)
        grams = B.mix(B.span_hash(sums, place, place + anchor))
        # The smallest hash and the leftmost place that has it, in one number.
        best = (_sliding_min((grams & ~_PLACE) | place.astype(np.uint64), length - anchor + 1) & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(np.append(start, best.size))
        end = start + count - 1 + length
        with np.errstate(over="ignore"):
            shape = (best[start] - start).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)
            content = B.mix(B.span_hash(sums, start, end) + B.mix(shape))
        parts.append((grams[best[start]], content, start + at, count))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts))


ENTRY = "bucket int, anchor binary, content binary, row binary, start binary, count binary, again binary"
_TYPES = {"anchor": np.uint64, "content": np.uint64, "row": np.int64, "start": np.int32, "count": np.int32, "again": np.bool_}
FOUND = "row_id long, start int, count int, shard long, hot boolean"


def _entries(buckets: int, length: int):
    """Contexts of each task, equal ones combined, packed by the bucket of their anchor."""

    def pack(have: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        e = {k: np.concatenate(v) for k, v in have.items()}
        order = np.lexsort((e["content"], e["anchor"]))
        e = {k: v[order] for k, v in e.items()}
        new = np.ones(order.size, bool)
        new[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["content"][1:] != e["content"][:-1])
        size = np.diff(np.append(np.flatnonzero(new), order.size))
        e["again"] = np.repeat(size > 1, size)
        # The first of equal contexts goes to its anchor's bucket; the others are known to be repeated.
        to = np.where(new, B.mix(e["anchor"]) % np.uint64(buckets), e["row"].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        e["anchor"] = np.where(new, e["anchor"], np.uint64(0))
        e["content"] = np.where(new, e["content"], np.uint64(0))
        order = np.argsort(to, kind="stable")
        to, e = to[order], {k: v[order] for k, v in e.items()}
        cut = np.searchsorted(to, np.arange(buckets + 1))
        for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            i, j = cut[b], cut[b + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32())] + [pa.array([np.ascontiguousarray(e[k][i:j], t).tobytes()], pa.binary()) for k, t in _TYPES.items()],
                ["bucket", *_TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list[np.ndarray]] = {k: [] for k in ("anchor", "content", "row", "start", "count")}
        seen = 0
        for batch in batches:
            for part in B.slices(batch, "text"):
                buf, at = B.text_bytes(part.column("text"))
                for r, i, j in zip(part.column("row_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    a, c, s, n = contexts(buf[i:j], length)
                    if a.size:
                        for k, v in zip(have, (a, c, np.full(a.size, r), s, n)):
                            have[k].append(v)
                seen += buf.size
                if seen >= COMBINE_BYTES and have["anchor"]:
                    yield from pack(have)
                    have, seen = {k: [] for k in have}, 0
        if have["anchor"]:
            yield from pack(have)

    return run


def _meet(shard_contexts: int):
    """Of each bucket: contexts that are repeated (no shard), and those to be sorted with others of their anchor."""

    def close(rows: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        e = {k: np.concatenate([r[k] for r in rows]) for k in _TYPES}
        known = e["anchor"] == 0
        order = np.lexsort((e["content"], e["anchor"]))
        e, known = {k: v[order] for k, v in e.items()}, known[order]
        new = np.ones(order.size, bool)
        new[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["content"][1:] != e["content"][:-1])
        size = np.diff(np.append(np.flatnonzero(new), order.size))
        repeated = known | e["again"] | np.repeat(size > 1, size)
        head = np.flatnonzero(new)
        anchor = e["anchor"][head]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        kinds = np.repeat(np.diff(np.append(first, anchor.size)), np.diff(np.append(first, anchor.size)))
        several = np.zeros(order.size, np.int64)
        several[head] = kinds
        sorts = (several > 1) & ~known
        parts = -(-several // shard_contexts)
        with np.errstate(over="ignore"):
            salt = np.where(parts > 1, e["content"] % np.maximum(parts, 1).astype(np.uint64) + np.uint64(1), np.uint64(0))
            shard = B.mix(e["anchor"] + salt * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        for pick, shards in ((repeated, False), (sorts, True)):
            at = np.flatnonzero(pick)
            for i in range(0, at.size, 50_000):
                own = at[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(e["row"][own]), pa.array(e["start"][own]), pa.array(e["count"][own]),
                    pa.array(shard[own] if shards else [None] * own.size, pa.int64()), pa.array(parts[own] > 1),
                ], ["row_id", "start", "count", "shard", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for i, b in enumerate(batch.column("bucket").to_pylist()):
                if b != now and rows:
                    yield from close(rows)
                    rows = []
                now = b
                rows.append({k: np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in _TYPES.items()})
        if rows:
            yield from close(rows)

    return run


CONTEXT = "shard long, hot boolean, row_id long, start int, data binary"


def _cut(length: int):
    """The bytes of the contexts to be sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text", 1 << 20):
                made: list[tuple] = []
                for row, text, own in zip(part.column("row_id").to_pylist(), part.column("text"), part.column("sorts").to_pylist()):
                    data = text.as_py()
                    made += [(x["shard"], x["hot"], row, x["start"], data[x["start"] : x["start"] + x["count"] - 1 + length]) for x in own]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
                for i in range(0, len(made), 2000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*made[i : i + 2000]), types)], ["shard", "hot", "row_id", "start", "data"])

    return run


STARTS = "row_id long, start int, count int, bucket int, windows binary"
#: A window of a dealt anchor: hash, place, and whether it is known to be repeated.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("row", "<i8"), ("start", "<i4"), ("known", "?")])


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and offset of each window, and whether its bytes also start at another place in ``texts``."""
    sizes = np.array([len(t) for t in texts])
    # Characters 2 to 257; 1 ends a text and 0 the string.
    body = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    body[ends] = 1
    s = np.append(body, 0)
    owner = np.repeat(np.arange(sizes.size), sizes + 1)
    left = np.append(ends[owner] - np.arange(body.size), 0)
    sa = suffix_array(s)
    before = neighbours(sa)
    # Limits keep a prefix inside both texts, so that the two end marks never count as bytes.
    common = permuted_lcp(np.append(np.where(body > 1, body - 2, 0), 0), before, left)
    again = np.zeros(s.size, bool)
    i = np.flatnonzero(common >= length)
    again[i] = True
    again[before[i]] = True
    at = np.flatnonzero(left >= length)
    return owner[at], at - (ends[owner[at]] - sizes[owner[at]]), again[at]


def _runs(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of consecutive numbers in ``place``."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1])) if place.size else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, place.size))


def _sort(length: int, buckets: int):
    """Repeated windows of each shard as runs; of dealt shards also all windows by hash, packed by bucket."""

    def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[3] for r in rows]
        owner, offset, again = repeated_windows(texts, length)
        row, start = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        i = np.flatnonzero(again)
        # Two texts are a gap apart, so that no run goes from one to the next.
        first, count = _runs(i + owner[i])
        yield _starts(row[owner[i[first]]], start[owner[i[first]]] + offset[i[first]], count)
        hot = np.array([r[4] for r in rows])
        pick = np.flatnonzero(hot[owner])
        if not pick.size:
            return
        buf = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0] + [len(t) for t in texts])[:-1]
        at = base[owner[pick]] + offset[pick]
        one, two = B.prefix_sums(buf), B.prefix_sums(255 - buf)
        found = np.empty(pick.size, WINDOW)
        found["a"], found["b"] = B.span_hash(one, at, at + length), B.span_hash(two, at, at + length)
        found["row"], found["start"], found["known"] = row[owner[pick]], start[owner[pick]] + offset[pick], again[pick]
        # A window that is repeated here is sent once; it may tell another shard.
        found = found[np.unique(found[["a", "b"]], return_index=True)[1]]
        to = (B.mix(found["a"].copy()) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            yield _starts(np.zeros(1, np.int64), np.zeros(1), np.zeros(1), k, found[order[cut[k] : cut[k + 1]]].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now = [], 0, None
        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "row_id", "start", "data", "hot"))
            for r in zip(*(c.to_pylist() for c in columns)):
                if r[0] != now and size >= ARRAY_BYTES:
                    yield from close(rows)
                    rows, size = [], 0
                now = r[0]
                rows.append(r)
                size += len(r[3])
        if rows:
            yield from close(rows)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that several shards of an anchor hold, where they are held once."""

    def close(parts: list[bytes]) -> pa.RecordBatch:
        w = np.frombuffer(b"".join(parts), WINDOW)
        _, at, n = np.unique(w[["a", "b"]], return_inverse=True, return_counts=True)
        w = w[(n[at] > 1) & ~w["known"]]
        return _starts(w["row"], w["start"], np.ones(w.size))

    now, parts = None, []
    for batch in batches:
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("windows")):
            if b != now and parts:
                yield close(parts)
                parts = []
            now = b
            parts.append(data.as_py())
    if parts:
        yield close(parts)


def _starts(row: np.ndarray, start: np.ndarray, count: np.ndarray, bucket: int | None = None, windows: bytes | None = None) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays([
        pa.array(row, pa.int64()), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(count, np.int32)),
        pa.array([bucket] * n, pa.int32()), pa.array([windows] * n, pa.binary()),
    ], ["row_id", "start", "count", "bucket", "windows"])


def _remove(length: int, kept: bool):
    """Remove the bytes of the repeated windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for part in B.slices(batch, "text"):
                made = []
                for text, marks in zip(part.column("text"), part.column("marks")):
                    data = np.frombuffer(text.as_py(), np.uint8)
                    edges = np.zeros(data.size + 1, np.int32)
                    start = marks.values.field("start").to_numpy()
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + marks.values.field("count").to_numpy() - 1 + length, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    rest = data[~gone].tobytes()
                    made.append((data.size, int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest if kept else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, kept: bool = False, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` per row of ``docs``, with ``kept`` also ``kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another;
    all are judged on the input. Null texts are empty. Repeated rows are texts like any others, so equal
    ones of at least ``length`` bytes go whole. Other columns are not read. ``docs`` is read twice and has to give
    the same rows in the same order, as a table does.
    """
    if length <= ANCHOR_BYTES:
        raise ValueError(f"length has to exceed {ANCHOR_BYTES}")
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("row_id", "text").mapInArrow(_entries(buckets, length), ENTRY).repartition("bucket").sortWithinPartitions(
        "bucket").mapInArrow(_meet(shard_contexts), FOUND)
    asked = met.groupBy("row_id").agg(
        F.collect_list(F.when(F.col("shard").isNull(), F.struct("start", "count"))).alias("marks"),
        F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "hot", "start", "count"))).alias("sorts"))
    met_any = F.col("marks").isNotNull()
    work = materialize(rows.join(asked, "row_id", "left").select(
        "row_id", "doc_id", F.length("text").cast("long").alias("n_bytes"),
        F.when(~met_any, F.sha2("text", 256)).alias("kept_sha256"), F.when(met_any | F.lit(kept), F.col("text")).alias("text"),
        "marks", "sorts"), "suffix-work")
    found = work.where("size(sorts) > 0").select("row_id", "text", "sorts").mapInArrow(_cut(length), CONTEXT).repartition(
        "shard").sortWithinPartitions("shard").mapInArrow(_sort(length, buckets), STARTS)
    found = materialize(found, "suffix-starts")
    # A window that two shards of one anchor hold is repeated wherever it is held once.
    across = found.where("bucket is not null").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across, STARTS)
    # These grow with the texts, so the texts are never joined by a broadcast.
    more = found.where("bucket is null").unionByName(across).groupBy("row_id").agg(
        F.collect_list(F.struct("start", "count")).alias("more")).hint("merge")
    whole = work.where("size(sorts) = 0").select("doc_id", "text", "marks")
    partly = work.where("size(sorts) > 0").join(more, "row_id", "left").select(
        "doc_id", "text", F.concat("marks", F.coalesce("more", F.array().cast("array<struct<start:int,count:int>>"))).alias("marks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = whole.unionByName(partly).mapInArrow(
        _remove(length, kept), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    same = work.where("marks is null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256",
        F.col("text").alias("kept"))
    out = changed.unionByName(same)
    return out if kept else out.drop("kept")
