"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one set. A set is first compared with its representative, the set it shares
most rare shingles with among the first ones of its shingles. Sets linked with one representative are a group; the others are
grouped by the first set they meet. Groups are cut into blocks of bounded size, and each block's union of first
shingles is stored as rows of a matrix. It tells how many of a set's first shingles any member of a block has, which
bounds what the set can have in common with a member; where that reaches the threshold, a second bound is taken from
parity sketches, a few bits per shingle: sketches differ in at most as many bits as their sets in shingles. Only where
both bounds allow a link is the block opened and are whole sets shipped, and only of members that may be linked. Sets
and blocks of one linked group are never compared, so a large group of copies costs a row per set and not per pair.

Exactness: two sets with Jaccard of at least t share at least t of each, so each shares one of the
first (1 - t) n + 1 shingles in any order common to both. Two orders are used. The first is by hash, but shingles that
stand out in a count over all documents, kept in a table of fixed size, come last: links are found whatever the
counts say. Sets that have a crowded shingle among these first ones, one of more than ``CROWD`` sets, are ordered anew by
frequency among such sets: near copies with edits of their own then start with these and do not
meet. A pair of which one set has no crowded shingle shares none, and is found in the first order; a pair of which
both have is found in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import bytes_np as B
from granary.llm.common import by_place, counted_rows, drop, listed, materialize, scratch, sent_if_small
from granary.llm.components import components

SHINGLE_WORDS = 4
THRESHOLD = 85  # percent
#: Counters of the frequency table, and how many travel in one row.
COUNTERS, CHUNK = 1 << 21, 1 << 14
#: Sets that share a first shingle, beyond which they are ordered by exact frequency.
CROWD = 256
#: Sets and shingles in one block; a single larger set is a block of its own.
BLOCK_SETS, BLOCK_TOKENS = 16, 200_000
#: Sets compared with one block in one task.
QUERIES = 256


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle, none are empty."""
    w = B.words(*B.text_bytes(column), lower=True)
    h, i = B.windows(w, k)
    row = w.row[i]
    first = np.searchsorted(row, np.arange(len(column) + 1))
    out = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    few = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < k))
    for r in few.tolist():
        own = w.hash[w.first[r] : w.first[r + 1]]
        digest = hashlib.blake2b(own.tobytes(), digest_size=8, person=b"short").digest()
        out[r] = np.frombuffer(digest, np.uint64)
    return out


def first_ones(n: int, threshold: int) -> int:
    """How many shingles in order hold one of any linked set's; none of an empty set."""
    return n + (-threshold * n // 100) + 1 if n else 0


def parity_sketch(tokens: np.ndarray) -> bytes:
    """For each of 2 n bits or more, a power of two, whether an odd number of the ``n`` shingles hash to it."""
    bits = max(64, 1 << int(2 * tokens.size - 1).bit_length())
    # The hash's middle bits: its low ones choose counters, its high ones are alike in the first shingles by hash.
    at = ((tokens >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two sketches differ, the larger one folded to the size of the smaller: at most the number of
    shingles that one set has and the other has not."""
    while x.size > y.size:
        x = x[: x.size // 2] ^ x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] ^ y[y.size // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def frequent_slots(docs: DataFrame, k: int) -> np.ndarray:
    """Whether a counter stands out, from all documents: by more than chance and a few copies explain.

    Tasks send their counters in chunks, the chunks are added up in a stream, and the driver
    gets COUNTERS numbers, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in B.slices(batch, "text"):
                h, _ = B.windows(B.words(*B.text_bytes(part.column("text")), lower=True), k)
                np.add.at(total, _slot(h), 1)
        yield from rows({i: total[i * CHUNK : (i + 1) * CHUNK] for i in range(COUNTERS // CHUNK)})

    def rows(chunks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, c in chunks.items():
            if c.any():
                # All lowest bytes first, all highest last: the zeros of small counts lie together.
                planes = np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([planes], pa.binary())], ["chunk", "counts"])

    def counts(planes: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                chunks[i] = chunks.get(i, 0) + counts(c.as_py())
        yield from rows(chunks)

    kind = "chunk int, counts binary"
    added = _texts(docs).mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind)
    total = np.zeros(COUNTERS, np.int64)
    for r in added.collect():
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = counts(r["counts"])
    mean = total.mean()
    return total > mean + 6 * np.sqrt(mean) + 8


def signatures(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``row_id``, ``doc_id``, ``n_shingles``, ``set_key`` and ``sketch`` (null if empty), ``prefix`` of each row, written once."""
    slots = docs.sparkSession.sparkContext.broadcast(frequent_slots(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = slots.value
        for batch in batches:
            for part in B.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                prefix = []
                for x in sets:
                    n = first_ones(x.size, threshold)
                    late = frequent[_slot(x)]
                    prefix.append(np.concatenate([x[~late], x[late]])[:n] if late.any() else x[:n])
                ends = np.cumsum([0] + [p.size for p in prefix])
                yield pa.RecordBatch.from_arrays([
                    part.column("row_id"), part.column("doc_id"), pa.array([x.size for x in sets], pa.int64()),
                    pa.array([set_key(x) if x.size else None for x in sets], pa.binary()),
                    pa.array([parity_sketch(x) if x.size else None for x in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64))),
                ], ["row_id", "doc_id", "n_shingles", "set_key", "sketch", "prefix"])

    rows = docs.select("row_id", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(
        rows.mapInArrow(run, "row_id long, doc_id long, n_shingles long, set_key binary, sketch binary, prefix array<long>"),
        "join-signatures")


def _set_texts(docs: DataFrame, sets: DataFrame, more: list[str], row_bytes: Column) -> DataFrame:
    """``text``, ``set_id``, ``set_key`` and ``more`` of the documents that stand for ``sets``, a written table.

    Another text with the same id is another set, told by its key where the text is read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).alias("d")
    return rows.join(sent_if_small(sets, row_bytes).alias("t"), F.expr("d.doc_id <=> t.rep")).select("text", "set_id", "set_key", *more)


def _by_frequency(docs: DataFrame, crowded: DataFrame, k: int, threshold: int) -> DataFrame:
    """``token`` and ``set_id`` of the first shingles of crowded sets, ordered by how many of these sets have them."""
    texts = _set_texts(docs, crowded, [], F.lit(60))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "text", 1 << 20):
                found = shingle_sets(part.column("text"), k)
                own = [(s, x) for s, key, x in zip(part.column("set_id").to_pylist(), part.column("set_key").to_pylist(), found)
                       if x.size and set_key(x) == key]
                if own:
                    ends = np.cumsum([0] + [x.size for _, x in own])
                    tokens = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), pa.array(np.concatenate([x for _, x in own]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int64()), tokens], ["set_id", "tokens"])

    held = materialize(texts.mapInArrow(run, "set_id long, tokens array<long>"), "join-crowded")
    each = held.select("set_id", F.explode("tokens").alias("token"))
    # Rows that repeat a set are counted too, for all sets alike: the order stays one order.
    often = materialize(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-frequencies")
    ranked = each.join(sent_if_small(often, F.lit(40)), "token", "left").groupBy("set_id").agg(
        F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("order"))
    n = F.size("order").cast("long")
    first = F.slice("order", F.lit(1), (n - F.ceil(n * threshold / 100) + 1).cast("int"))
    # A shingle that one set alone has meets nothing.
    return ranked.select("set_id", F.explode(first).alias("f")).where("f.df > 1").select("f.token", "set_id")


def _led(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``sets``, how many share the token, and ``leader``, the smallest of them, where there are two at least."""
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("set_id").alias("leader")).where("sets > 1")
    return tokens.join(shared, "token")


def _needed(n: Column, y: Column, threshold: int) -> Column:
    """What a link between sets of ``n`` and ``y`` asks of the number of first shingles they share.

    Let k be common to the first ones. Of the set whose first ones end earlier in the order, all but its first ones may
    be common too, less than t times its size, so the overlap is below k + t max(n, y). A link needs t / (1 + t) (n + y).
    Rounding must not lose a pair that just reaches the bound.
    """
    t = threshold / 100
    return t / (1 + t) * (n + y) - t * F.greatest(n, y) - 1e-6


def _representatives(hits: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``set_id`` and ``leader``: of each set's leaders that it may be linked with, the one it shares most with."""
    met = hits.where("set_id <> leader").groupBy("set_id", "leader", "exact").agg(F.count(F.lit(1)).alias("k"))
    size = sets.select("set_id", F.col("n_shingles").alias("n"))
    met = met.join(size, "set_id").join(size.select(F.col("set_id").alias("leader"), F.col("n").alias("y")), "leader")
    n, y = F.col("n"), F.col("y")
    return met.where((100 * F.least(n, y) >= threshold * F.greatest(n, y)) & (F.col("k") >= _needed(n, y, threshold))).groupBy(
        "set_id").agg(F.max(F.struct("k", (-F.col("leader")).alias("l"))).alias("best")).select("set_id", (-F.col("best.l")).alias("leader"))


def _groups(stars: DataFrame) -> DataFrame:
    """``set_id`` and ``group`` of the sets linked with a representative (``a`` with ``b``), and of the representatives.

    A representative comes before its sets, and one that has its own takes its group from there; longer chains stay apart.
    """
    above = stars.select(F.col("a").alias("set_id"), F.col("b").alias("up"))
    top = above.select(F.col("set_id").alias("up"), F.col("up").alias("top"))
    own = above.join(top, "up", "left").select("set_id", F.coalesce("top", "up").alias("group"))
    heads = above.select(F.col("up").alias("set_id")).distinct().join(above, "set_id", "left_anti")
    return own.unionByName(heads.select("set_id", F.col("set_id").alias("group")))


def _blocks(hits: DataFrame, sets: DataFrame, crowded: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """``set_id``, ``n``, size ``class``, ``crowded``, ``linked`` group (or null) and ``block`` of each set that shares a first shingle."""
    own = hits.groupBy("set_id").agg(F.min("leader").alias("leader")).join(
        sets.select("set_id", F.col("n_shingles").alias("n")), "set_id").join(
        crowded.select("set_id", F.lit(True).alias("crowded")), "set_id", "left").fillna(False, ["crowded"]).join(
        groups.select("set_id", F.col("group").alias("linked")), "set_id", "left")
    own = own.withColumn("class", F.floor(F.log("n") / float(np.log(100 / threshold))).cast("int")).withColumn(
        "key", F.xxhash64(F.coalesce("linked", "leader"), F.col("linked").isNotNull(), "class", "crowded"))
    cuts = own.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).select(
        "key", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)).alias("cuts"))
    return own.join(cuts, "key").select("set_id", "n", "class", "crowded", "linked", F.xxhash64(
        "key", F.pmod(F.xxhash64("set_id"), F.col("cuts"))).alias("block"))


def _opened(hits: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """``set_id`` and ``block`` of the blocks a set has to be compared with, from the token-group matrix.

    What a link asks of the shared first shingles is least for the smallest or the largest member of a block.
    """
    at = hits.select("exact", "token", "set_id").join(members, "set_id")
    # A shingle within one linked group tells nothing new.
    apart = at.groupBy("exact", "token").agg(
        F.min(F.coalesce("linked", "set_id")).alias("low"), F.max(F.coalesce("linked", "set_id")).alias("high")).where("low < high")
    at = materialize(at.join(apart.select("exact", "token"), ["exact", "token"]), "join-matrix")
    union = materialize(at.groupBy("exact", "token", "block", "class", "crowded", "linked").agg(F.count(F.lit(1)).alias("sets")), "join-unions")
    met = at.alias("x").join(union.alias("c"), F.expr("""
        x.exact = c.exact and x.token = c.token and abs(x.class - c.class) <= 1
        and (x.exact or not (x.crowded and c.crowded)) and not coalesce(x.linked = c.linked, false)
        and (x.block < c.block or x.block = c.block and c.sets > 1)"""))
    counted = met.groupBy("x.set_id", "x.n", "c.block", "x.exact").agg(F.count(F.lit(1)).alias("k"))
    sizes = members.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    t = threshold / 100
    n, low, high = F.col("n"), F.greatest("low", F.col("n") * t), F.least("high", F.col("n") / t)
    needs = [_needed(n, y, threshold) for y in (low, high)]
    return counted.join(sizes, "block").where((low <= high + 1e-6) & (F.col("k") >= F.least(*needs))).select("set_id", "block").distinct()


def _places(members: DataFrame, opened: DataFrame) -> DataFrame:
    """``set_id`` with the ``block``, ``share`` and role of each comparison it takes part in.

    A block's queries are dealt into shares of bounded size; its members go to each of them.
    """
    shares = opened.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("shares"))
    queries = opened.join(shares, "block").select(
        "set_id", "block", F.pmod(F.xxhash64("set_id"), F.col("shares")).alias("share"), F.lit(True).alias("query"))
    held = members.join(shares, "block").select(
        "set_id", "block", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"), F.lit(False).alias("query"))
    return queries.unionByName(held)


def _near(signed: DataFrame, members: DataFrame, opened: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """``members`` and ``opened`` without the sets that no sketch allows a link with: columns ``set_id``, ``block``."""
    sketches = signed.select(F.col("row_id").alias("set_id"), F.col("n_shingles").alias("n"), "sketch")
    dealt = _places(members, opened).join(sketches, "set_id").repartition("block", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            made: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("block", "share", "query", "set_id", "n", "sketch"))
            for block, share, query, s, n, data in zip(*columns):
                if (block, share) != now:
                    now, held = (block, share), []
                x = np.frombuffer(data, np.uint8)
                if not query:  # members come first
                    held.append((s, n, x))
                    continue
                near = [y for y, m, other in held if y != s and 100 * min(n, m) >= threshold * max(n, m)
                        and (100 + threshold) * sketch_distance(x, other) <= (100 - threshold) * (n + m)]
                if near:
                    made.append((s, block, True))
                    made += [(y, block, False) for y in near]
            names, types = ["set_id", "block", "query"], [pa.int64(), pa.int64(), pa.bool_()]
            made = list(set(made))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)

    kept = materialize(dealt.sortWithinPartitions("block", "share", "query").mapInArrow(
        run, "set_id long, block long, query boolean").distinct(), "join-near")
    return kept.where("not query").drop("query"), kept.where("query").drop("query")


class Block:
    """The sets of one block, by token."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids = ids
        self.sizes = np.array([y.size for y in sets])
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def links(self, x: np.ndarray, threshold: int) -> list[int]:
        """Members linked with ``x``; none are compared if its overlap with the block's union is too small."""
        lo, hi = np.searchsorted(self.token, x, "left"), np.searchsorted(self.token, x, "right")
        inside = hi > lo
        if 100 * int(inside.sum()) < threshold * x.size:
            return []
        lo, n = lo[inside], (hi - lo)[inside]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.ids))
        linked = np.flatnonzero(100 * common >= threshold * (x.size + self.sizes - common))
        return [self.ids[j] for j in linked.tolist()]


def links(docs: DataFrame, signed: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links ``a``, ``b`` between set ids that span every component of similar sets."""
    spark = docs.sparkSession
    # The shingles are dealt once, for their counts and for the lookup of those that are shared.
    tokens = signed.join(sets.select(F.col("set_id").alias("row_id")), "row_id", "left_semi").select(
        F.col("row_id").alias("set_id"), F.explode("prefix").alias("token")).repartition("token")
    met = materialize(_led(tokens), "join-hits")
    crowded = materialize(met.where(F.col("sets") > CROWD).select("set_id").distinct().join(
        sets.select("set_id", "set_key", "rep"), "set_id"), "join-crowd")
    with scratch() as made:
        ranked = materialize(_by_frequency(docs, crowded, k, threshold), "join-ranked")
    hits = met.where(F.col("sets") <= CROWD).withColumn("exact", F.lit(False)).unionByName(
        _led(ranked).withColumn("exact", F.lit(True))).drop("sets")
    hits = materialize(hits, "join-firsts")
    drop(spark, met, *made)

    with scratch() as made:
        best = materialize(_representatives(hits, sets, threshold), "join-representatives")
        heads = best.select(F.col("leader").alias("set_id"), F.col("leader").alias("block")).distinct()
        asked = best.select("set_id", F.col("leader").alias("block"))
        found = _compared(docs, sets, *_near(signed, heads, asked, threshold), k, threshold)
    stars = materialize(found, "join-stars")
    drop(spark, *made)

    members = materialize(_blocks(hits, sets, crowded, _groups(stars), threshold), "join-blocks")
    with scratch() as made:
        found = _opened(hits, members, threshold)
    opened = materialize(found, "join-opened")
    drop(spark, hits, crowded, *made)
    near = _near(signed, members.select("set_id", "block"), opened, threshold)
    return stars.unionByName(_compared(docs, sets, *near, k, threshold))


def _compared(docs: DataFrame, sets: DataFrame, members: DataFrame, opened: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links ``a``, ``b`` of the sets in ``opened`` with the members of their block, as many as connect what is linked there."""
    places = _places(members, opened).groupBy("set_id").agg(F.collect_list(F.struct("block", "share", "query")).alias("places"))
    texts = materialize(places.join(sets.select("set_id", "set_key", "rep"), "set_id"), "join-places")
    rows = _set_texts(docs, texts, ["places"], 100 + 40 * F.size("places"))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["block", "share", "query", "set_id", "tokens"], [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        for batch in batches:
            for part in B.slices(batch, "text", 1 << 20):
                made: list[tuple] = []
                found = shingle_sets(part.column("text"), k)
                for x, s, key, own in zip(found, *(part.column(c).to_pylist() for c in ("set_id", "set_key", "places"))):
                    if x.size and set_key(x) == key:
                        made += [(p["block"], p["share"], p["query"], s, x.tobytes()) for p in own]
                for i in range(0, len(made), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[i : i + 256]), types)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, root = None, {}, None, {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        for batch in batches:
            made = []
            for place, share, query, s, data in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if (place, share) != now:
                    now, held, block, root = (place, share), {}, None, {}
                x = np.frombuffer(data, np.uint64)
                if not query:  # members come first
                    held[s] = x
                    continue
                block = block or Block(list(held), list(held.values()))
                for y in block.links(x, threshold):
                    u, v = top(s), top(y)
                    if u != v:  # a link inside a component already found here adds nothing
                        root[max(u, v)] = min(u, v)
                        made.append((s, y))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = rows.mapInArrow(content, "block long, share long, query boolean, set_id long, tokens binary").repartition("block", "share")
    return dealt.sortWithinPartitions("block", "share", "query").mapInArrow(compare, "a long, b long")


def join(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``row_id``, ``doc_id``, ``n_shingles``, ``component_id``, ``first_row`` of each row of ``docs`` (with ``row_id``).

    A component is what links connect; ``component_id`` is its smallest doc_id, ``first_row`` the row that has
    it. Null texts and texts without words are empty sets, linked with nothing. Rows with equal sets are linked.
    A null doc_id is never the smallest unless all are null. Other columns are not read.
    """
    signed = signatures(docs, k, threshold)
    filled = signed.where("set_key is not null")
    sets = materialize(filled.groupBy("set_key").agg(
        F.min("row_id").alias("set_id"), F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_id"))).alias("low"),
    ), "join-sets")
    with scratch() as made:
        roots = components(links(docs, signed, sets, k, threshold))
    drop(docs.sparkSession, *made[:-1])  # the components read the table written last
    placed = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("low"), F.min("set_id").alias("row")).select(
        "root", F.col("low.doc_id").alias("component_id"), F.coalesce("low.row_id", "row").alias("first_row"))
    of_set = placed.select("set_key", "root").join(lowest, "root").drop("root")
    empty = signed.where("set_key is null").select(
        "row_id", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row_id").alias("first_row"))
    return filled.select("row_id", "doc_id", "n_shingles", "set_key").join(of_set, "set_key").drop("set_key").unionByName(empty)


def keep_one(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id, and their own columns."""
    rows = by_place(docs, "join-rows")
    with scratch() as made:
        found = join(rows.select("row_id", "row.doc_id", "row.text"), k, threshold)
    kept = materialize(listed(found.select("row_id", F.expr("int(row_id = first_row)").alias("n"))), "join-others")
    drop(docs.sparkSession, *made)
    return counted_rows(rows, kept).select("row.*")
