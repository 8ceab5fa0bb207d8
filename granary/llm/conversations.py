"""Conversation structure repair by Viterbi decoding with survivor coalescence.

A conversation's rows are kept, given another role, deleted, or joined by inserted rows, at the least cost that
leaves the role initials ``(s?(ua)+)?``. Four states say what has been read so far: nothing, the system
row, a user row, an assistant row. Each row extends a tree of backpointers by at most one node per state. Nodes
count the nodes that point to them; one that nothing points to is dropped, and once all survivors share an
ancestor, the edits up to it are final and leave the tree. What stays in memory are the rows since that ancestor.

Among equal costs the least string of edit initials wins. Two candidates for a state are compared by all their
edits since the node where they part, which is always still in the tree. Every label ends with the letter of its
row, so of two different strings neither is the beginning of the other, and the smaller one stays
the smaller one whatever follows.

A state is given up only if another one is strictly cheaper even after the dearest detour that makes up for the
difference (``DETOUR``), so neither the least cost nor its ties are lost, and the path that deletes everything
does not hold back the ancestor of all others.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
OK, BLANK, DUPLICATE, CUT = range(4)
#: DETOUR[j][i]: what completing any conversation from state j costs beyond completing it from state i, at most.
DETOUR = (
    (0, 0, INSERT, 0),
    (2 * INSERT, 0, INSERT, 2 * INSERT),
    (INSERT + DELETE, INSERT, 0, INSERT),
    (DELETE, 0, INSERT, 0),
)
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """States reached by inserted rows alone, with cost and label; longer runs come back to one of these."""
    yield state, 0, ""
    yield _NEXT[state], INSERT, "I"
    if state in (NOTHING, SYSTEM):
        yield ASSISTANT, 2 * INSERT, "II"


def _moves(initial: str, fault: int) -> tuple[list[tuple[int, int, str]], ...]:
    """Per state reached: the states it is reached from over one row, with cost and label, the best of each pair."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        for at, cost, label in _inserted(start):
            made = [(at, cost + DELETE, label + "D")]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                made.append((_NEXT[at], cost + REROLE + more, label + "R"))
                if initial == "s" and at == NOTHING:
                    made.append((SYSTEM, cost + more, label + "K"))
                elif initial == ("a" if at == USER else "u"):
                    made.append((_NEXT[at], cost + more, label + "K"))
            for to, c, text in made:
                best[start, to] = min(best.get((start, to), (c, text)), (c, text))
    return tuple([(s, *best[s, to]) for s in range(4) if (s, to) in best] for to in range(4))


MOVES = {(i, f): _moves(i, f) for i, f in product(("s", "u", "a", ""), range(4))}


class Node:
    """Backpointer: the best way to one state after one row. ``kids`` are the nodes that point here."""

    __slots__ = ("parent", "label", "state", "kids")

    def __init__(self, parent: Node | None, label: str, state: int) -> None:
        self.parent, self.label, self.state, self.kids = parent, label, state, []


def _earlier(a: Node, x: str, b: Node, y: str) -> bool:
    """Whether the edits to ``a`` and then ``x`` come before those to ``b`` and then ``y``."""
    left, right = [x], [y]
    while a is not b:
        left.append(a.label)
        right.append(b.label)
        a, b = a.parent, b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


def _drop(node: Node) -> None:
    """Remove a node that nothing points to, and its ancestors as far as nothing else does."""
    while not node.kids and node.parent is not None:
        node.parent.kids.remove(node)
        node = node.parent


class Decoder:
    """Edits of one conversation. ``add`` and ``end`` return those that have become final, in order.

    An edit is (initial, role, text): of the row itself, of the row in its new role, of a deleted row, of an inserted one.
    """

    def __init__(self) -> None:
        self.root = Node(None, "", NOTHING)
        self.alive: dict[int, tuple[int, Node]] = {NOTHING: (0, self.root)}
        self.rows: deque[tuple[str, str]] = deque()
        self.cost = 0

    def add(self, role: str, text: str, fault: int) -> list[tuple[str, str, str]]:
        self.rows.append((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        found: dict[int, tuple[int, Node, str]] = {}
        for to, ways in enumerate(MOVES[initial, fault]):
            best = None
            for start, cost, label in ways:
                if start not in self.alive:
                    continue
                base, node = self.alive[start]
                total = base + cost
                if best is None or total < best[0] or total == best[0] and _earlier(node, label, best[1], best[2]):
                    best = (total, node, label)
            if best:
                found[to] = best
        kept = [s for s in found if all(found[j][0] + DETOUR[j][s] >= found[s][0] for j in found)]
        old = [node for _, node in self.alive.values()]
        self.alive = {}
        for s in kept:
            cost, parent, label = found[s]
            node = Node(parent, label, s)
            parent.kids.append(node)
            self.alive[s] = (cost, node)
        for node in old:
            _drop(node)
        return self._final()

    def _final(self) -> list[tuple[str, str, str]]:
        out = []
        while len(self.root.kids) == 1:
            node = self.root.kids[0]
            out += self._edits(self.root.state, node.label)
            node.parent = None
            self.root = node
        return out

    def _edits(self, state: int, label: str) -> list[tuple[str, str, str]]:
        out = []
        for letter in label:
            if letter == "I":
                state = _NEXT[state]
                out.append(("I", _ROLE[state], ""))
                continue
            role, text = self.rows.popleft()
            if letter != "D":
                state = SYSTEM if letter == "K" and role[:1] == "s" else _NEXT[state]
            out.append((letter, _ROLE[state] if letter == "R" else role, text))
        return out

    def end(self) -> list[tuple[str, str, str]]:
        """The remaining edits; ``cost`` is the total from now on."""
        best = None
        for state, (cost, node) in self.alive.items():
            label = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]
            total = cost + INSERT * len(label)
            if best is None or total < best[0] or total == best[0] and _earlier(node, label, best[1], best[2]):
                best = (total, node, label)
        self.cost, node, label = best
        path = [label]
        while node is not self.root:
            path.append(node.label)
            node = node.parent
        return self._edits(self.root.state, "".join(reversed(path)))


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``held`` of the damaged rows; a dropped row stays with ``held`` false, so
    that no conversation is lost. Nulls in role and text, and in the key that picks the damage, are one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    hit = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"),
        filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("held"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows in order within their conversation, each with its first ``fault``.

    Conversations lie whole in a task, sorted by turn (nulls first), then role and text, so that repeated rows
    and rows of one turn have one order. Only the sort holds rows, and it spills.
    """
    last = F.regexp_like(F.col("text"), F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    same = Window.partitionBy("conv_id", "held", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~last, CUT).otherwise(OK))
    return rows.repartition("conv_id").withColumn("fault", fault.cast("int")).sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation changed, conv_id, turn, role, text, held, fault) of each row of a sorted stream."""
    now, first = None, True
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "held", "fault"))):
            yield (first or row[0] != now, *row)
            now, first = row[0], False


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``place``, ``edit``, ``role``, ``text`` of each edit of each conversation, in the order of ``place``.

    ``rows`` has conv_id, turn, role and text, other columns are not read; a column ``held`` false marks a row that does
    not count. Null roles and texts are one space, a null conv_id is a conversation of its own. Edits are K (as it is), R (other role),
    D (deleted) and I (inserted); what is not D is the repaired conversation. Conversations without rows have no edits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), *[pa.string()] * 3]
        made: list[tuple] = []
        decoder, conv, place = None, None, 0

        def note(edits: list[tuple[str, str, str]]) -> None:
            nonlocal place
            for e in edits:
                made.append((conv, place, *e))
                place += 1

        for new, own, _, role, text, held, fault in _conversations(batches):
            if new:
                if decoder:
                    note(decoder.end())
                decoder, conv, place = Decoder(), own, 0
            if held:
                note(decoder.add(role, text, fault))
            if len(made) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
                made = []
        if decoder:
            note(decoder.end())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    return faults(_held(rows)).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def _held(rows: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    held = F.coalesce(F.col("held"), F.lit(True)) if "held" in rows.columns else F.lit(True)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, held.alias("held"))


class Summary:
    """Counts of a conversation, its audit and the hash of its repaired text, taken as edits become final."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.decoder = conv_id, Decoder()
        self.counts, self.illegal, self.before = [0] * 4, 0, None
        self.low = self.turn = None
        self.turns = 0
        self.audit: list[str] = []
        self.hash, self.rows = hashlib.sha256(), 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.turn = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self._note(self.decoder.add(role, text, fault))

    def _note(self, edits: list[tuple[str, str, str]]) -> None:
        for letter, role, text in edits:
            self.audit.append(letter)
            if letter != "D":
                self.hash.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
                self.rows += 1

    def result(self) -> tuple:
        self._note(self.decoder.end())
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.decoder.cost, "".join(self.audit), self.hash.hexdigest())


def summaries(rows: DataFrame) -> DataFrame:
    """Per conversation: ``gaps`` in its turns, rows by first fault, ``illegal`` neighbours, the ``cost`` and ``audit`` of the
    cheapest repair, and the SHA-256 of the repaired conversation, ``role:text`` joined by newlines.

    Takes what :func:`repair` takes and sees the same edits as they become final; a conversation passes through one task row by
    row, since the hash of its whole text can only be taken in order. Conversations without held rows have zeros and an empty audit.
    """
    kind = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in kind.split(", ")]
        types = [*[pa.int64()] * 7, pa.string(), pa.string()]
        made: list[tuple] = []
        now = None
        for new, own, turn, role, text, held, fault in _conversations(batches):
            if new:
                if now:
                    made.append(now.result())
                now = Summary(own)
            if held:
                now.add(turn, role, text, fault)
            if len(made) > 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
                made = []
        if now:
            made.append(now.result())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    return faults(_held(rows)).mapInArrow(run, kind)
