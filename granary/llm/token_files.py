"""Token ids as Parquet list columns, in document order, read back selectively.

The file format is Parquet with one row per document: ``doc_id``, ``n_tokens`` and ``ids``, a list
of 32-bit ids. Row groups are small enough to be skipped by their doc_id range, pages carry
column indexes, and ids are dictionary-encoded while a chunk has few distinct ones; document
ids and counts are delta-encoded (format version 2). Lengths and starts are read without ids.
"""

from __future__ import annotations

import ctypes
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytes_np as B
from granary.llm.common import shuffles_dropped

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 256 << 10
#: Distinct pieces of text and distinct words, of 16 bytes on average at most, in a worker's tables; beyond them words are gathered
#: anew, and only pieces that were met again are kept.
CACHE_PIECES, CACHE_WORDS = 500_000, 1_000_000
#: Bytes of a word beyond which it is not remembered.
LONG_WORD = 256
#: Strings that are encoded in one text.
JOINT = 500
SCHEMA = "doc_id long, ids array<int>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: White space next to a space: such places are not cut. All branches begin with a space, which is searched for fast.
_WIDE = re.compile(r" (?:\s|$|(?<=\s )|(?<=^ ))")


def pieces(text: str) -> list[str]:
    """Cut before each single space between two characters that are no white space.

    The vocabulary's own splitting starts a token there whatever stands around, so the ids of
    a text are the ids of its pieces in order.
    """
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if not p or p[0].isspace() or not last or last[-1].isspace():
            out[-1] = last + " " + p
        else:
            out.append(" " + p)
    return out


#: As _WIDE on bytes, but for white space beyond ASCII only by the first byte of its character.
_BLANK, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.arange(256) == 0x20

#: Bytes that stand in no text of Latin letters, ASCII digits and marks, and line feeds; two of its characters' bytes are left, C3 97
#: and C3 B7, which are no letters. The vocabulary's own splitting of such texts is known, other words are not cut.
_UNCUT = np.ones(256, bool)
_UNCUT[[0x0A, *range(0x21, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = False
#: Their kinds of bytes.
_MARK, _LETTER, _DIGIT, _LINE = range(1, 5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_KIND[[*range(0x30, 0x3A)]], _KIND[0x0A], _KIND[0x20] = _DIGIT, _LINE, 0
#: What follows an apostrophe in a piece of its own: one letter or two.
_SHORT, _LONG = np.isin(np.arange(256), list(b"stmd")), [b"re", b"ve", b"ll"]
#: By size up to 8, the bits of so many bytes.
_BITS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: it else keeps what the arrays of slices took."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``pool`` one after another."""
    end = np.cumsum(size)
    at = np.repeat(start - (end - size), size)
    at += np.arange(at.size)
    return pool.take(at)


def cuts(text: np.ndarray) -> np.ndarray:
    """Where the vocabulary's own splitting starts a piece, in words that may be cut, each with the space before it.

    Pieces are runs of one kind of bytes, the first one of a word with its space. An apostrophe after another kind takes the ending
    of a contraction along, and of line feeds the last is a piece of its own.
    """
    kind = _KIND[text]
    first = np.ones(text.size + 3, bool)
    first[1:text.size] = (kind[1:] != kind[:-1]) & (kind[:-1] > 0)
    line = kind == _LINE
    first[: text.size - 1] |= line[:-1] & ~line[1:]
    mark = np.flatnonzero((text == 0x27) & first[: text.size])
    near = np.append(text, np.zeros(2, np.uint8))
    after, beyond = near[mark + 1], near[mark + 2]
    long = np.zeros(mark.size, bool)
    for x, y in _LONG:
        long |= (after == x) & (beyond == y)
    for of, n in ((mark[_SHORT[after]], 2), (mark[long], 3)):
        first[of + 1], first[of + n] = False, True
    return np.flatnonzero(first[: text.size])


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data``, which ends with eight bytes more, as one number."""
    return np.ndarray(data.size - 7, "<u8", data, 0, (1,))


def put(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` behind its first ``n`` values, and room for others."""
    if n + more.size > held.size:
        held = np.concatenate([held[:n], np.zeros(more.size + (n + more.size) // 2, held.dtype)])
    held[n : n + more.size] = more
    return held


class Table:
    """Byte strings with their token ids by hash; strings of one hash need not be equal, so that bytes are compared."""

    def __init__(self, kind: np.dtype) -> None:
        self.n, self.slots = 0, np.full(1 << 12, -1, np.int32)
        self.hash, self.again = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.letters, self.letters_at = np.zeros(8, np.uint8), np.zeros(1, np.int32)
        self.ids, self.ids_at = np.zeros(0, kind), np.zeros(1, np.int32)

    def _settle(self, place: np.ndarray) -> None:
        last = self.slots.size - 1
        at = (self.hash[place] & np.uint64(last)).astype(np.int64)
        while place.size:
            free = self.slots[at] < 0
            self.slots[at[free]] = place[free]
            go = self.slots[at] != place
            place, at = place[go], (at[go] + 1) & last

    def add(self, hashes: np.ndarray, letters: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Strings one after another, of new hashes, with their sizes, and so their ids."""
        n, m = self.n, self.n + hashes.size
        self.hash, self.again = put(self.hash, n, hashes), put(self.again, n, np.zeros(hashes.size, bool))
        self.letters = put(self.letters, int(self.letters_at[n]), np.append(letters, np.zeros(8, np.uint8)))
        self.letters_at = put(self.letters_at, n + 1, self.letters_at[n] + np.cumsum(size, dtype=np.int32))
        self.ids = put(self.ids, int(self.ids_at[n]), ids)
        self.ids_at = put(self.ids_at, n + 1, self.ids_at[n] + np.cumsum(count, dtype=np.int32))
        self.n, start = m, n
        if 2 * m > self.slots.size:
            start, self.slots = 0, np.full(1 << (2 * m).bit_length(), -1, np.int32)
        self._settle(np.arange(start, m, dtype=np.int32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the string of each hash, or -1."""
        last = self.slots.size - 1
        at = (hashes & np.uint64(last)).astype(np.int64)
        out = self.slots.take(at)
        todo = np.flatnonzero((self.hash.take(out) != hashes) & (out >= 0))
        while todo.size:
            at[todo] = (at[todo] + 1) & last
            place = out[todo] = self.slots.take(at[todo])
            todo = todo[(self.hash.take(place) != hashes[todo]) & (place >= 0)]
        return out

    def unlike(self, place: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which strings of ``data``, which ends with eight bytes more, are not those at their places; no place is unlike."""
        begin = self.letters_at.take(place).astype(np.int64)
        out = (place < 0) | (self.letters_at.take(place + 1) - begin != size)
        held, given = eights(self.letters), eights(data)
        todo, k = np.flatnonzero(~out), 0
        while todo.size:
            differ = held[begin[todo] + k] ^ given[start[todo] + k]
            out[todo[differ & _BITS.take(np.minimum(size[todo] - k, 8)) != 0]] = True
            k += 8
            todo = todo[size[todo] > k]
        return out

    def full(self, n: int) -> bool:
        """Whether there are more than ``n`` strings, or more than 16 bytes for each of so many."""
        return self.n > n or self.letters_at[self.n] > 16 * n

    def met_again(self) -> Table:
        """The strings that were marked in ``again``; none if these are most of them."""
        made, keep = Table(self.ids.dtype), np.flatnonzero(self.again[: self.n])
        size, count = self.letters_at[keep + 1] - self.letters_at[keep], self.count(keep)
        if 2 * keep.size < self.n and 2 * size.sum() < self.letters_at[self.n]:
            made.add(self.hash[keep], gathered(self.letters, self.letters_at[keep], size), size, gathered(self.ids, self.ids_at[keep], count), count)
        return made

    def count(self, place: np.ndarray) -> np.ndarray:
        return self.ids_at.take(place + 1) - self.ids_at.take(place)


class Encoder:
    """Encodes with the tokenizer, each distinct word and piece once while it is remembered.

    Words after a space are found in a table by hash, and their bytes are compared; ids are gathered for many texts at once.
    New words are cut where the vocabulary's own splitting cuts them, their pieces are found in a second table in the same way, and
    only pieces that are new are encoded, many in one call. A table of words that is full is gathered anew, one of pieces keeps those
    that were met again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A token's characters stand for one byte each.
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.length.size <= 1 << 16 else "<i4")
        self.pieces = Table(self.kind)
        self.other: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """An empty table of words."""
        self.words = Table(self.kind)

    @property
    def hash(self) -> np.ndarray:
        """The hashes of the words that are remembered."""
        return self.words.hash[: self.words.n]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joint(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings after a mark, in the place of the byte before each, and how many each has with its mark: many are encoded in
        one text, and the tokens' lengths tell."""
        if not start.size:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        joined, ends = gathered(data, start - 1, size + 1), np.cumsum(size + 1)
        joined[ends - size - 1] = mark
        text, at = joined.tobytes(), [0, *ends[JOINT - 1 : -1 : JOINT].tolist(), int(ends[-1])]
        ids = np.concatenate(self._encode([text[i:j].decode() for i, j in zip(at, at[1:])]))
        return ids, np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1, prepend=0)

    def _meet(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each piece in the table of pieces, into which new ones are put; -1 for those that share a hash with another."""
        if self.pieces.full(CACHE_PIECES):
            self.pieces = self.pieces.met_again()
        hashes = B.mix(B.span_hash(B.prefix_sums(text), start, start + size))
        place = self.pieces.find(hashes)
        self.pieces.again[place[place >= 0]] = True
        miss = np.flatnonzero(place < 0)
        if miss.size:
            new = miss[np.unique(hashes[miss], return_index=True)[1]]
            begin = text[start[new]]
            after, line = begin == 0x20, begin == 0x0A
            after, inside, lines = new[after], new[~after & ~line], new[line]
            ids, count = self._joint(text, start[after] + 1, size[after] - 1, 0x20)
            # A line feed before another character is a token of its own, left out here.
            own, more = self._joint(text, start[inside], size[inside], 0x0A)
            if inside.size:
                own = np.delete(own, np.cumsum(more) - more)
            feeds = self._encode(["\n" * n for n in size[lines].tolist()])
            order = np.concatenate([after, inside, lines])
            self.pieces.add(hashes[order], gathered(text, start[order], size[order]), size[order], np.concatenate([ids, own, *feeds]),
                            np.concatenate([count, more - 1, np.array([x.size for x in feeds], np.int64)]))
            place[miss] = self.pieces.find(hashes[miss])
        place[self.pieces.unlike(place, np.append(text, np.zeros(8, np.uint8)), start, size)] = -1
        return place

    def _learn(self, buf: np.ndarray, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of words that stand after a space, and in that order their ids and how many each has."""
        strange = _UNCUT[buf]
        strange[:-1] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        for content in self.added:
            i = data.find(content)
            while i >= 0:
                strange[i] = True
                i = data.find(content, i + 1)
        uncut = np.add.reduceat(gathered(strange, start, size), np.cumsum(size) - size, dtype=np.int64) > 0
        uncut |= (buf[start] == 0x0A) | (buf[start + size - 1] == 0x0A)
        cut = np.flatnonzero(~uncut)
        own, sizes = np.zeros(0, self.kind), np.zeros(0, np.int64)
        if cut.size:
            # Each word with the byte before it, a space.
            text = gathered(buf, start[cut] - 1, size[cut] + 1)
            at = cuts(text)
            place = self._meet(text, at, np.diff(at, append=text.size))
            word = np.cumsum(text[at] == 0x20) - 1
            lost = np.zeros(cut.size, bool)
            lost[word[place < 0]] = True
            uncut[cut[lost]] = True
            cut, place, word = cut[~lost], place[~lost[word]], word[~lost[word]]
            count = self.pieces.count(place)
            own = gathered(self.pieces.ids, self.pieces.ids_at[place], count)
            sizes = np.bincount(word, count, lost.size).astype(np.int64)[~lost]
        whole = np.flatnonzero(uncut)
        last = np.array([data[i : i + n].decode()[-1].isspace() for i, n in zip(start[whole].tolist(), size[whole].tolist())], bool)
        ids, count = self._joint(buf, start[whole[~last]], size[whole[~last]], 0x20)
        more = self._encode([data[i - 1 : i + n].decode() for i, n in zip(start[whole[last]].tolist(), size[whole[last]].tolist())])
        return (np.concatenate([cut, whole[~last], whole[last]]), np.concatenate([own, ids, *more]),
                np.concatenate([sizes, count, np.array([x.size for x in more], np.int64)]))

    def _wide(self, buf: np.ndarray, at: np.ndarray, data: bytes) -> dict[int, str]:
        """The texts that have white space next to a space, by row."""
        space = np.flatnonzero(buf == 0x20)
        near = np.concatenate([np.zeros(3, np.uint8), buf, np.zeros(1, np.uint8)])
        edge = np.zeros(buf.size + 1, bool)
        edge[at] = True
        after = near[space + 4]
        maybe = space[edge[space] | edge[space + 1] | _BLANK[after] | _LEAD[after] | _BLANK[near[space + 2]]
                      | _LEAD[near[space + 1]] | _LEAD[near[space]]]
        rows = np.unique(np.searchsorted(at, maybe, "right") - 1).tolist()
        texts = {r: data[at[r] : at[r + 1]].decode() for r in rows}
        return {r: t for r, t in texts.items() if _WIDE.search(t)}

    def _places(self, buf: np.ndarray, data: bytes, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, which stands after a space; -1 for those that are not in the table."""
        if self.words.full(CACHE_WORDS):
            self._forget()
        place = self.words.find(hashes)
        miss = np.flatnonzero((place < 0) & (size <= LONG_WORD))
        if miss.size:
            new = miss[np.unique(hashes[miss], return_index=True)[1]]
            for own in np.split(new, np.flatnonzero(np.diff(np.cumsum(size[new]) // B.BLOCK)) + 1):
                order, ids, count = self._learn(buf, data, start[own], size[own])
                own = own[order]
                self.words.add(hashes[own], gathered(buf, start[own], size[own]), size[own], ids, count)
            place[miss] = self.words.find(hashes[miss])
        place[self.words.unlike(place, np.append(buf, np.zeros(8, np.uint8)), start, size)] = -1
        return place

    def column(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, the end id last; null text has only that."""
        if len(self.other) > CACHE_PIECES:
            self.other = {}
        buf, at = B.text_bytes(texts)
        data, n = buf.tobytes(), len(texts)
        wide = self._wide(buf, at, data)
        w = B.words(buf, at, separator=_SPACE)
        after = np.flatnonzero(w.start != at[w.row])
        if wide:
            after = after[~np.isin(w.row[after], list(wide))]
        start, size, row = w.start[after], w.end[after] - w.start[after], w.row[after]
        place = self._places(buf, data, start, size, w.hash[after])

        # Units in order: what each text begins with, its words after a space, its end.
        first = np.searchsorted(row, np.arange(n + 1)) + 2 * np.arange(n + 1)
        unit, size_of = np.zeros(first[-1], np.int64), np.ones(first[-1], np.int64)
        units = np.arange(row.size) + 2 * row + 1
        unit[units], size_of[units] = self.words.ids_at[place], self.words.count(place)
        begin = [pieces(wide[r]) if r in wide else [data[i : w.end[w.first[r]]].decode()] if i < j else []
                 for r, (i, j) in enumerate(zip(at.tolist(), at[1:].tolist()))]
        lost = np.flatnonzero(place < 0)
        alone = [data[i - 1 : i + k].decode() for i, k in zip(start[lost].tolist(), size[lost].tolist())]
        new = list({p for own in begin for p in own if p not in self.other})
        encoded = self._encode(new + alone)
        self.other.update((p, x.tobytes()) for p, x in zip(new, encoded))
        more = [b"".join(map(self.other.__getitem__, own)) for own in begin] + [x.tobytes() for x in encoded[len(new) :]]
        odd, sizes = np.concatenate([first[:-1], units[lost]]), np.array([len(x) // self.kind.itemsize for x in more], np.int64)
        # Behind the words' ids come the end id and the others, for this time.
        held = int(self.words.ids_at[self.words.n])
        self.words.ids = put(self.words.ids, held, np.frombuffer(np.array([END_ID], self.kind).tobytes() + b"".join(more), self.kind))
        unit[first[1:] - 1] = held
        unit[odd], size_of[odd] = held + 1 + np.cumsum(sizes) - sizes, sizes
        ends = np.concatenate([[0], np.cumsum(size_of)])[first]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gathered(self.words.ids, unit, size_of).astype("<i4")))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        rows = self.column(pa.array(texts, pa.large_string()))
        at, ids = rows.offsets.to_numpy(), rows.values.to_numpy()
        return [ids[i : j - 1].tobytes() for i, j in zip(at, at[1:])]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary; a worker serves many tasks."""
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of each row of ``docs``, the end id last; null text has only that."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        try:
            for batch in batches:
                for part in B.slices(batch, "text", 1 << 19):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), made.column(part.column("text"))], ["doc_id", "ids"])
        finally:  # a worker keeps its pieces; other stages use it too
            made._forget()
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the token files of ``docs`` to ``path`` in ascending doc_id order, null ids first.

    Rows are dealt by ranges of doc_id; adaptive execution joins ranges to files of its
    advisory size. Rows with the same id are ordered by their text, so that a repeated id
    does not fill one file. Spark's committer publishes whole files only.
    """
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("k")).repartitionByRange(
        "doc_id", "k").sortWithinPartitions("doc_id", "k")
    rows = encode(ordered, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    with shuffles_dropped(docs.sparkSession):
        rows.write.options(**{
            "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP_BYTES,
            "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false",
        }).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """The token rows, or those of a doc_id range: row groups and pages outside it are skipped."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").between(*doc_ids))


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids as little-endian 32-bit integers."""
    at = np.asarray(ids.offsets)
    data = np.ascontiguousarray(np.asarray(ids.values), "<u4").view(np.uint8)
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each row.

    Files hold ascending ranges, so a row's start is the total of the files before its own
    plus the rows before it there. The totals are one row per file and come from ``n_tokens`` alone.
    """
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file")
    rows = read_tokens(spark, path).select(
        "doc_id", "n_tokens", ids_crc32("ids").alias("ids_crc32"), file, F.col("_metadata.row_index").alias("place"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = read_tokens(spark, path).select("n_tokens", file).groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(files, "file").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
