"""Benchmark decontamination: word-pair seeds, then local alignment of passage and test item.

Words are runs of letters, digits and non-ASCII characters, A-Z read as a-z. Seeds are pairs
of words of an item that are neighbours or have one word between. Rare seeds tell which documents can hold which item;
where such a document holds enough seeds of the item, rare or not, close together, the surrounding passage and
the item are aligned word by word (Smith-Waterman), which scores copies with changed, added or missing words.

Exactness: an alignment of M matches and X edits scores 2 M - X. Let it reach the share s of the best
score 2 n of an item of n words. Its M - 1 steps from match to match hold X edits, so at most
X / 2 <= M - s n of them hold two or more. The other s n - 1 steps or more hold one edit or none; each starts
at a word of its own, and its two words are a seed in the item and in the document. The passage has
at most M + X <= (3 - 2 s) n words. So no passage that the alignment would accept is left out, however
its edits are spread and however common its words are. As it holds seeds from at least s n - 1 words of the item, it holds one
from the words that stay when any s n - 2 of them are left out; those left out are the ones with the most common seeds. How common a
seed is, is judged by the words of the test items, and decides on the work to do, not on what is found.

The test items are a stated query set: they reach the tasks in blocks of bounded size, and a
larger benchmark means more passes over the documents.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytes_np as B
from granary.llm.common import materialize

#: Items of fewer words are not looked for.
MIN_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score of an item from which a passage counts as a copy.
MIN_SCORE = 0.5
#: Bytes of test items in one block.
BLOCK_BYTES = 1 << 20
#: Bytes of text whose seeds are looked up at a time.
SLICE_BYTES = 1 << 20

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
]))
_SIEVE_BITS = 20


@dataclass
class Items:
    """A block of test items and the word pairs that lead to them."""

    ids: list[int | None]
    words: list[np.ndarray]
    seed: np.ndarray  # sorted hashes, one entry per (pair, item)
    item: np.ndarray
    rare: np.ndarray  # the same for the rare seeds
    rare_item: np.ndarray

    def sieves(self) -> tuple[np.ndarray, np.ndarray]:
        """For all seeds and for the rare ones: which low bits of a hash occur."""
        out = np.zeros((2, 1 << _SIEVE_BITS), bool)
        for own, seeds in zip(out, (self.seed, self.rare)):
            own[(seeds & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)] = True
        return out[0], out[1]


def word_pairs(w: B.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each two words of one row that are neighbours or have one word between, and the index of the first."""
    hashes, first = [], []
    for step in (1, 2):
        i = np.flatnonzero(w.row[:-step] == w.row[step:])
        with np.errstate(over="ignore"):
            hashes.append(B.mix(B.mix(w.hash[i]) + w.hash[i + step]))
        first.append(i)
    return np.concatenate(hashes), np.concatenate(first)


def _sorted_pairs(h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, item), by hash."""
    if not h.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((item, h))
    h, item = h[order], item[order]
    new = np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1]))
    return h[new], item[new]


def _rare_starts(w: B.Words, min_score: float) -> np.ndarray:
    """Which words' seeds are rare seeds: all but the ``need - 1`` words of each item whose seeds are made of the most common words."""
    _, known, counts = np.unique(w.hash, return_inverse=True, return_counts=True)
    common = np.log(counts[known])
    weight = np.full(w.hash.size, -np.inf)
    for step in (1, 2):
        i = np.flatnonzero(w.row[:-step] == w.row[step:])
        weight[i] = np.maximum(weight[i], common[i] + common[i + step])
    # Words without a seed, the last ones, are not among those that the bound speaks of.
    need, _ = bounds(np.diff(w.first), min_score)
    order = np.lexsort((np.arange(w.hash.size), -weight, w.row))
    rank = np.arange(w.hash.size) - w.first[w.row[order]]
    rare = np.ones(w.hash.size, bool)
    rare[order[rank < need[w.row[order]] - 1]] = False
    return rare


def index_items(rows: list[tuple[int | None, str | None]], min_score: float = MIN_SCORE) -> Items:
    """All word pairs of the items. An item of fewer than ``MIN_WORDS`` words cannot be looked for."""
    column = pa.array([t for _, t in rows], pa.large_string())
    w = B.words(*B.text_bytes(column), lower=True, separator=SEPARATOR)
    h, i = word_pairs(w)
    item = w.row[i]
    long = np.diff(w.first)[item] >= MIN_WORDS
    rare = long & _rare_starts(w, min_score)[i]
    return Items([r[0] for r in rows], [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])],
                 *_sorted_pairs(h[long], item[long]), *_sorted_pairs(h[rare], item[rare]))


def bounds(size: np.ndarray, min_score: float) -> tuple[np.ndarray, np.ndarray]:
    """Of items of ``size`` words: the seeds any accepted passage has, and the words it has at most."""
    need = np.ceil(min_score * size - 1 - 1e-9).astype(np.int64)
    return np.maximum(need, 1), np.ceil((3 - 2 * min_score) * size + 1e-9).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and first and last passage word of it."""
    n = passage.size
    steps = np.arange(n + 1)
    above, start_above = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in item:
        # A score and the passage word its alignment starts at travel together, the start in the low digits.
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        score, start = np.zeros(n + 1, np.int64), steps.copy()
        score[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start[1:] = np.where(score[1:] == 0, steps[1:], np.where(diagonal >= up, start_above[:-1], start_above[1:]))
        # Gaps along the passage: the best earlier cell less a gap for each word passed over.
        lifted = (score - GAP * steps) * (n + 2) - start
        run = np.maximum.accumulate(lifted)
        value = -((-run) // (n + 2))
        moved = value + GAP * steps
        better = moved > score
        start = np.where(better, value * (n + 2) - run, start)
        score = np.where(better, moved, score)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k - 1)
        above, start_above = score, start
    return best


def _found(h: np.ndarray, i: np.ndarray, sieve: np.ndarray, seed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and first words of the pairs that are among ``seed``."""
    near = np.flatnonzero(sieve[(h & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)])
    h, i = h[near], i[near]
    lo, hi = np.searchsorted(seed, h, "left"), np.searchsorted(seed, h, "right")
    counts = hi - lo
    first = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if h.size else lo
    return owner[first + np.arange(counts.sum())], np.repeat(i, counts)


def _hits(w: B.Words, items: Items, sieves: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Item and first word of the column's seeds, by row, item and word; each (item, word) once.

    Only of rows and items that have a rare seed in common.
    """
    h, i = word_pairs(w)
    n = len(items.ids)
    item, word = _found(h, i, sieves[1], items.rare, items.rare_item)
    candidates = np.unique(w.row[word] * n + item)
    held = np.zeros(w.first.size, bool)
    held[candidates // n] = True
    inside = np.flatnonzero(held[w.row[i]])
    item, word = _found(h[inside], i[inside], sieves[0], items.seed, items.item)
    pair = w.row[word] * n + item
    at = np.minimum(np.searchsorted(candidates, pair), max(candidates.size - 1, 0))
    wanted = candidates[at] == pair if candidates.size else np.zeros(pair.size, bool)
    item, word = item[wanted], word[wanted]
    order = np.lexsort((word, item, w.row[word]))
    item, word = item[order], word[order]
    new = np.ones(word.size, bool)
    new[1:] = (item[1:] != item[:-1]) | (word[1:] != word[:-1])
    return item[new], word[new]


def _passages(item: np.ndarray, word: np.ndarray, row: np.ndarray, need: np.ndarray, span: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Where enough seeds of an item lie close together: index of a passage's first seed, and its first and last word."""
    last = np.arange(word.size) + need[item] - 1
    at = np.flatnonzero(last < word.size)
    to = last[at]
    ok = (item[to] == item[at]) & (row[to] == row[at]) & (word[to] - word[at] <= span[item[at]])
    at, to = at[ok], to[ok]
    cut = np.ones(at.size, bool)
    cut[1:] = (row[at[1:]] != row[at[:-1]]) | (item[at[1:]] != item[at[:-1]]) | (word[at[1:]] - word[to[:-1]] > 2 * span[item[at[1:]]])
    first = np.flatnonzero(cut)
    for a, b in zip(first, np.append(first[1:], at.size)):
        around = span[item[at[a]]]
        yield int(at[a]), int(word[at[a]] - around), int(word[to[b - 1]] + around + 1)


def leaks(docs: DataFrame, items: Items, text: str = "text", min_score: float = MIN_SCORE) -> tuple[Column, Broadcast]:
    """Column of the items found in a text of ``docs``: item_id, score 0 to 1, first and last word; and the index the tasks get.

    Best passage per item. Null and empty texts have none. Repeated item ids are reported once per row.
    """
    known = docs.sparkSession.sparkContext.broadcast((items, items.sieves()))

    def run(column: pa.Array) -> pa.Array:
        block, sieves = known.value
        size = np.array([len(x) for x in block.words])
        need, span = bounds(size, min_score)
        out: list[list] = []
        for part in B.slices(pa.RecordBatch.from_arrays([column], ["t"]), "t", SLICE_BYTES):
            w = B.words(*B.text_bytes(part.column("t")), lower=True, separator=SEPARATOR)
            rows: list[dict] = [{} for _ in range(part.num_rows)]
            item, word = _hits(w, block, sieves)
            row = w.row[word]
            for at, first, last in _passages(item, word, row, need, span):
                k, r = int(item[at]), int(row[at])
                lo, hi = max(int(w.first[r]), first), min(int(w.first[r + 1]), last + 1)
                score, s, e = align(block.words[k], w.hash[lo:hi])
                share = score / (MATCH * size[k])
                if share >= min_score and share > rows[r].get(k, (0.0,))[0]:
                    rows[r][k] = (share, lo + s - int(w.first[r]), lo + e - int(w.first[r]))
            out += [
                [{"item_id": block.ids[k], "score": v[0], "first_word": v[1], "last_word": v[2]} for k, v in sorted(x.items())]
                for x in rows
            ]
        kind = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
        return pa.array(out, pa.list_(kind))

    return F.arrow_udf(run, LEAK)(F.col(f"`{text}`").cast("string")), known


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The test items in blocks of about ``block_bytes`` of text, one block in memory at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def add_leaks(docs: DataFrame, benchmark: DataFrame, out: str = "leaks", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the items found in each text; other columns stay, ``out`` must not be one of them.

    An empty benchmark or one without usable items finds nothing. A benchmark of one block is looked up as the rows go by. With more
    blocks the rows are numbered and written first, each block makes a pass of its own that writes what it finds,
    and its index is dropped before the next one is made.
    """
    made = blocks(benchmark, block_bytes)
    items, more = index_items(next(made)), next(made, None)
    if more is None:
        found = leaks(docs, items, text)[0] if items.seed.size else F.array().cast(LEAK)
        return docs.withColumn(out, found)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), row.alias("row")), "leak-rows")
    texts, parts = rows.select("row_id", F.col(f"row.`{text}`").alias("text")), []
    for block in itertools.chain([items, index_items(more)], map(index_items, made)):
        if block.seed.size:
            found, known = leaks(texts, block)
            parts.append(materialize(texts.select("row_id", F.explode(found).alias("leak")), "leak-block"))
            known.destroy()
    if not parts:
        return rows.select("row.*", F.array().cast(LEAK).alias(out))
    all_found = functools.reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(F.sort_array(F.collect_list("leak")).alias("leaks"))
    joined = rows.join(all_found, "row_id", "left")
    return joined.select("row.*", F.coalesce("leaks", F.array().cast(LEAK)).alias(out))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no passage of a test item, with their own columns."""
    at = next(f"leaks_{i}" for i in range(len(docs.columns) + 1) if f"leaks_{i}" not in docs.columns)
    return add_leaks(docs, benchmark, at, text).where(F.size(at) == 0).drop(at)
