"""Rule bitmask ledger: every rule once per document, policies and ablations by bit arithmetic.

A ledger row holds the measurements and ``fail_bits``, one bit per rule that the document
fails. A policy is a mask over those bits, so a changed policy reads the ledger and never the
texts again; what each rule adds to a policy follows from counts per bit pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import bytes_np as B

REPEAT_WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the struct of measurements; a bit never changes its meaning."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_short", lambda m: m.n_words < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
    Rule(2, "symbols", lambda m: 100 * m.n_symbols > 20 * m.n_words),
    Rule(3, "repeated_lines", lambda m: (m.n_lines >= 4) & (100 * m.n_dup_lines > 50 * m.n_lines)),
    Rule(4, "short_words", lambda m: m.word_chars < 2 * m.n_words),
    Rule(5, "long_words", lambda m: m.word_chars > 40 * m.n_words),
)
BASE = Policy("base", ("too_short", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", ("too_short", "repeated_windows", "symbols")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def _measure(text: pa.Array) -> pa.Array:
    out = {m: np.zeros(len(text), np.int64) for m in MEASURES}
    done = 0
    for part in B.slices(pa.RecordBatch.from_arrays([text], ["t"]), "t"):
        rows = slice(done, done + part.num_rows)
        done += part.num_rows
        buf, at = B.text_bytes(part.column("t"))
        w = B.words(buf, at)

        def per_row(flag: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
            return sums[at[1:]] - sums[at[:-1]]

        out["n_words"][rows] = np.diff(w.first)
        out["word_chars"][rows] = per_row(((buf & 0xC0) != 0x80) & ~B.SPACE[buf])
        out["n_symbols"][rows] = per_row(SYMBOLS[buf])
        data = buf.tobytes()
        lines = [
            [x for x in data[a:b].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist())
        ]
        out["n_lines"][rows] = [len(x) for x in lines]
        out["n_dup_lines"][rows] = [len(x) - len(set(x)) for x in lines]
        h, i = B.windows(w, REPEAT_WINDOW)
        with np.errstate(over="ignore"):
            h = B.mix(h + w.row[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(h.size, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        depth = np.zeros(w.hash.size + 1, np.int64)
        np.add.at(depth, i[again], 1)
        np.add.at(depth, i[again] + REPEAT_WINDOW, -1)
        out["n_repeat_words"][rows] = np.bincount(w.row[np.cumsum(depth)[:-1] > 0], minlength=part.num_rows)
    return pa.StructArray.from_arrays([pa.array(out[m]) for m in MEASURES], list(MEASURES))


measure = F.arrow_udf(_measure, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))


def _bit(on: Column, bit: int) -> Column:
    return F.when(on, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[name] for name in policy.rules)


def rejected(bits: Column, policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy, rules)).cast("long")) != 0


def add_ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "ledger") -> DataFrame:
    """``docs`` with one more column, a struct of the measurements and ``fail_bits``.

    All other columns stay, whatever their names; ``out`` must not be one of them. A null text
    measures as an empty one: no words, so it is too short. Repeated rows are rated alike.
    """
    measured = docs.withColumn(out, measure(F.col(f"`{text}`")))
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(_bit(rule.fails(F.col(out)), rule.bit))
    return measured.withColumn(out, F.col(out).withField("fail_bits", bits))


def ablations(ledger: DataFrame, bits: str = "fail_bits", policies: Sequence[Policy] = POLICIES,
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents, what the policy rejects, what this rule fails, what it
    alone rejects, and what the policy without it would keep.

    Documents are first counted per bit pattern, at most 2^rules rows however many documents
    there are; everything else reads those counts.
    """
    counts = ledger.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(
            F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"),
            F.lit(mask(p, rules)).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit"),
        )
        for p in policies for r in rules if r.name in p.rules
    ])
    one = counts.withColumn("c", F.explode(cases)).select("bits", "n", "c.*")
    hit = F.col("bits").bitwiseAND(F.col("mask"))

    def total(on: Column) -> Column:
        return F.sum(F.when(on, F.col("n")).otherwise(0))

    return one.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(hit != 0).alias("n_rejected"),
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only_this"),
        total((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: Policy = POLICIES[-1], text: str = "text") -> DataFrame:
    """Rows that pass ``policy``, with their own columns."""
    at = next(f"ledger_{i}" for i in range(len(docs.columns) + 1) if f"ledger_{i}" not in docs.columns)
    return add_ledger(docs, text, out=at).where(~rejected(F.col(at).fail_bits, policy)).drop(at)
