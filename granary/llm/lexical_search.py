"""Ranked lexical search by Block-Max MaxScore over a sharded index.

A shard is an inverted index of some documents, sorted by doc_id: a list per term, in blocks of BLOCK postings,
each with its first document, its largest number of occurrences and the least length of its documents. From
these follows the most a posting of the block can score, whatever the totals of the corpus are, so the index is written in one
pass, without a shuffle, and no block is unpacked to learn its bound.

A query takes a shard's lists in order of their largest bound. Lists whose bounds together do not beat the k-th best score are
non-essential: only documents of the other, essential lists are candidates. On a non-essential list, a
candidate that the bound of the block it would be in cannot lift over the k-th best score is given up, and only blocks that
some remaining candidate needs are unpacked. Each task keeps the best k of its shards, and the tasks' are merged.

Words are runs of letters, digits and non-ASCII characters, A-Z read as a-z, and are known by 64 bits of hash. All
scores are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm import bytes_np as B
from granary.llm.decontaminate import SEPARATOR, blocks

#: Fixed values of the score: a term counts SCALE * tf div (1000 * tf + 20 * m), m from 50 upwards with the length.
SCALE, TF, LENGTH, BASE, SPAN = 1_000_000_000, 1000, 20, 50, 50
TOP = 50
#: Postings in a block; bytes of text and documents in a shard.
BLOCK, SHARD_BYTES, SHARD_DOCS = 128, 32 << 20, 1 << 16
#: Documents whose candidates are looked at together.
WINDOW = 2048
#: A head row per shard (term null) has ids and lengths of its documents, the other rows a list each.
INDEX = ("shard long, term long, df long, words long, ids array<long>, lengths array<int>, "
         "first binary, most binary, shortest binary, gap_bytes int, gaps binary, tf_bytes int, tfs binary")
_TYPES = [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3, pa.int32(), pa.binary(), pa.int32(), pa.binary()]
_NAMES = [c.split(" ")[0] for c in INDEX.split(", ")]
_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _term_words(column: pa.Array) -> B.Words:
    return B.words(*B.text_bytes(column), lower=True, separator=SEPARATOR)


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and number of occurrences of each term of each row, and the length of each row."""
    w = _term_words(column)
    order = np.lexsort((w.hash, w.row))
    term, row = w.hash[order], w.row[order]
    new = np.ones(term.size, bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return term[at], row[at], np.diff(np.append(at, term.size)), np.diff(w.first)


def _width(most: np.ndarray) -> np.ndarray:
    """Index into _WIDTHS of the narrowest type that holds each value."""
    return (most > 0xFF).astype(int) + (most > 0xFFFF)


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def invert(shard: int, ids: list[int | None], found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard from the occurrences of its slices, ordered by term."""
    length = np.concatenate([f[3] for f in found])
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)), np.int64)
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    length = length[order]
    starts = np.cumsum([0] + [f[3].size for f in found])
    doc = place[np.concatenate([f[1] + s for f, s in zip(found, starts)])]
    term, tf = np.concatenate([f[0] for f in found]).view(np.int64), np.concatenate([f[2] for f in found])
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    empty = [None] * 7
    yield _rows([[x] for x in (shard, None, None, int(length.sum()), [ids[i] for i in order.tolist()], length.tolist(), *empty)])
    if not term.size:
        return
    edge = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(edge, term.size))
    head = (np.arange(term.size) - np.repeat(edge, df)) % BLOCK == 0
    block = np.flatnonzero(head)
    first = doc[block].astype("<i4")
    most = np.maximum.reduceat(tf, block).astype("<i4")
    shortest = np.minimum.reduceat(length[doc], block).astype("<i4")
    gap = np.diff(doc, prepend=0)
    gap[head] = 0
    wide = [_width(np.maximum.reduceat(x, edge)).tolist() for x in (gap, tf)]
    packed = [[x.astype(t) for t in _WIDTHS] for x in (gap, tf)]
    ends, lists = (edge + df).tolist(), np.append(np.searchsorted(block, edge), block.size).tolist()
    for lo in range(0, edge.size, 4096):
        part = range(lo, min(lo + 4096, edge.size))
        a, b, p, q = edge[lo : lo + 4096].tolist(), ends[lo : lo + 4096], lists[lo : lo + 4096], lists[lo + 1 : lo + 4097]
        none = [None] * len(part)
        data = [[packed[k][wide[k][i]][x:y].tobytes() for i, x, y in zip(part, a, b)] for k in (0, 1)]
        yield _rows([
            [shard] * len(part), term[edge[lo : lo + 4096]].tolist(), df[lo : lo + 4096].tolist(), none, none, none,
            *[[x[u:v].tobytes() for u, v in zip(p, q)] for x in (first, most, shortest)],
            wide[0][lo : lo + 4096], data[0], wide[1][lo : lo + 4096], data[1]])


def write_index(docs: DataFrame, path: str) -> None:
    """Write the index of ``docs`` (doc_id, text), each task its own shards. Null texts are empty; documents without terms are in
    the index but in no list. No documents give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        ids: list = []
        found: list[tuple] = []
        size = 0
        for batch in batches:
            for part in B.slices(batch, "text", 2 << 20):
                text = part.column("text")
                if ids and (size + text.nbytes > SHARD_BYTES or len(ids) + part.num_rows > SHARD_DOCS):
                    yield from invert(shard, ids, found)
                    shard, ids, found, size = shard + 1, [], [], 0
                found.append(occurrences(text))
                ids += part.column("doc_id").to_pylist()
                size += text.nbytes
        if ids:
            yield from invert(shard, ids, found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


@dataclass
class Totals:
    """Documents with a term, and all their terms."""

    docs: int
    words: int

    def m(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - SPAN + SPAN * lengths.astype(np.int64) * self.docs // max(self.words, 1)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf.astype(np.int64) // (TF * tf.astype(np.int64) + LENGTH * m)


class Postings:
    """One term's list in a shard. Blocks are unpacked when they are first needed."""

    def __init__(self, row: dict, m: np.ndarray, totals: Totals) -> None:
        self.df, self.m = row["df"], m
        self.first = np.frombuffer(row["first"], "<i4").astype(np.int64)
        # The impact grows with the occurrences and shrinks with the length.
        self.bound = _impact(np.frombuffer(row["most"], "<i4"), totals.m(np.frombuffer(row["shortest"], "<i4")))
        self.best = int(self.bound.max())
        self.gaps = np.frombuffer(row["gaps"], _WIDTHS[row["gap_bytes"]])
        self.tfs = np.frombuffer(row["tfs"], _WIDTHS[row["tf_bytes"]])
        # A packed block reads as its first document throughout, so the whole is in order at any time.
        self.docs = np.repeat(self.first, BLOCK)[: self.df]
        self.impact = np.zeros(self.df, np.int64)
        self.open = np.zeros(self.first.size, bool)

    def unpack(self, wanted: np.ndarray) -> None:
        wanted = wanted[~self.open[wanted]]
        if not wanted.size:
            return
        self.open[wanted] = True
        at = wanted[:, None] * BLOCK + np.arange(BLOCK)
        inside = at < self.df
        gap = np.where(inside, self.gaps[np.minimum(at, self.df - 1)], 0).astype(np.int64)
        docs = self.first[wanted][:, None] + np.cumsum(gap, axis=1)
        at, docs = at[inside], docs[inside]
        self.docs[at] = docs
        self.impact[at] = _impact(self.tfs[at], self.m[docs])

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents in [lo, hi) and their impacts."""
        a, b = max(int(np.searchsorted(self.first, lo, "right")) - 1, 0), int(np.searchsorted(self.first, hi, "left"))
        self.unpack(np.arange(a, b))
        docs = self.docs[a * BLOCK : b * BLOCK]
        i, j = np.searchsorted(docs, (lo, hi))
        return docs[i:j], self.impact[a * BLOCK : b * BLOCK][i:j]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block each document would be in, and the bound there; -1 and 0 before the first one."""
        block = np.searchsorted(self.first, docs, "right") - 1
        return block, np.where(block >= 0, self.bound[block], 0)

    def values(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impacts of documents whose blocks are given; 0 for those not in the list."""
        self.unpack(np.unique(block[block >= 0]))
        at = np.minimum(np.searchsorted(self.docs, docs), self.df - 1)
        return np.where((block >= 0) & (self.docs[at] == docs), self.impact[at], 0)


@dataclass
class Shard:
    """A shard's documents and those of its lists that queries ask for."""

    ids: list
    m: np.ndarray
    lists: dict[int, Postings] = field(default_factory=dict)

    def top(self, terms: list[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """The best ``k`` (score, place) above ``floor`` for weighted terms: by score, then the earlier document."""
        own = [(w * self.lists[t].best, w, self.lists[t]) for t, w in terms if w > 0 and t in self.lists]
        own = sorted((x for x in own if x[0] > 0), key=lambda x: x[0])
        ahead = np.cumsum([0] + [x[0] for x in own]).tolist()  # what the lists before one can add
        best, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = self.m.size
        for lo in range(0, n, WINDOW):
            hi = min(lo + WINDOW, n)
            essential = next((i for i in range(len(own)) if ahead[i + 1] > floor), len(own))
            if essential == len(own):
                break  # no document can be better any more
            score = np.zeros(hi - lo, np.int64)
            for _, w, own_list in own[essential:]:
                docs, impact = own_list.between(lo, hi)
                score[docs - lo] += w * impact
            docs = np.flatnonzero(score + ahead[essential] > floor)
            docs = docs[score[docs] > 0]
            score, docs = score[docs], docs + lo
            for i in range(essential - 1, -1, -1):
                if not docs.size:
                    break
                _, w, own_list = own[i]
                block, bound = own_list.bounds(docs)
                stay = score + w * bound + ahead[i] > floor
                docs, score, block = docs[stay], score[stay], block[stay]
                score = score + w * own_list.values(docs, block)
            stay = score > floor
            best, at = np.concatenate([best, score[stay]]), np.concatenate([at, docs[stay]])
            if best.size > k:
                order = np.lexsort((at, -best))[:k]
                best, at = best[order], at[order]
            if best.size >= k:
                floor = max(floor, int(best.min()))  # later documents of the same score come after
        order = np.lexsort((at, -best))
        return list(zip(best[order].tolist(), at[order].tolist()))


def _query_terms(rows: list[tuple[int | None, str | None]]) -> list[list[int]]:
    w = _term_words(pa.array([t for _, t in rows], pa.large_string()))
    return [np.unique(w.hash[a:b]).view(np.int64).tolist() for a, b in zip(w.first[:-1], w.first[1:])]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query``, ``item_id``, ``rank``, ``doc_id``, ``score`` of the best ``k`` documents for each row of ``queries`` (item_id, text).

    Only scores above 0 count; equal ones are ranked by doc_id, a null doc_id first. Queries with null texts or without terms find
    nothing; rows with one item_id are queries of their own. Queries come in blocks of bounded size, with the
    frequencies of their own terms; more of them mean more passes over the lists they ask for.
    """
    index = read_index(spark, path)
    heads = index.where("term is null").select("words", F.size(F.filter("lengths", lambda n: n > 0)).alias("n"))
    n, words = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    totals, found, before = Totals(n, words), None, 0
    for rows in blocks(queries):
        asked = _query_terms(rows)
        # One row per distinct term of the block.
        terms = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for own in asked for t in own})], "term long"))
        lists = index.join(terms, "term", "left_semi")
        ratio = F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
        weighed = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.ln(ratio)).cast("long").alias("w"))
        weight = {r.term: r.w for r in weighed.collect()}
        plan = spark.sparkContext.broadcast([[(t, weight[t]) for t in own if t in weight] for own in asked])
        own = _best(lists.unionByName(index.where("term is null")), plan, totals, k)
        names = spark.createDataFrame([(i, before + i, r[0]) for i, r in enumerate(rows)], "item int, query long, item_id long")
        own = own.join(F.broadcast(names), "item").drop("item")
        found = own if found is None else found.unionByName(own)
        before += len(rows)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "item_id", "rank", "doc_id", "score")


def _best(lists: DataFrame, plan, totals: Totals, k: int) -> DataFrame:
    """``item``, ``doc_id``, ``score``: the best ``k`` of each task's shards."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        now, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if shard:
                        yield shard
                    now, shard = row["shard"], Shard(row["ids"], totals.m(np.array(row["lengths"], np.int64)))
                else:
                    shard.lists[row["term"]] = Postings(row, shard.m, totals)
        if shard:
            yield shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = plan.value
        best: list[list[tuple]] = [[] for _ in asked]  # (-score, has an id, id) in order
        for shard in shards(batches):
            for i, terms in enumerate(asked):
                # A document of another shard with the k-th score may still come first by its id.
                floor = max(-best[i][k - 1][0] - 1, 0) if len(best[i]) >= k else 0
                more = [(-s, shard.ids[at] is not None, shard.ids[at] or 0) for s, at in shard.top(terms, k, floor)]
                if more:
                    best[i] = sorted(best[i] + more)[:k]
        made = [(i, d if has else None, -s) for i, own in enumerate(best) for s, has, d in own]
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return lists.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term")).mapInArrow(
        run, "item int, doc_id long, score long")
