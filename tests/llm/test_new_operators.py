"""Conversation repair, sharding and lexical search against brute force and on unusual rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm import conversations as C
from granary.llm import lexical_search as L
from granary.llm import sharding as S

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string, row_no int, part int, shard int"


# ------------------------------------------------------------------ conversations


def cheapest(rows):
    """All repairs of rows (role, fault), with up to two insertions in each gap: the least cost and audit."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?\Z")
    edits = []
    for role, fault in rows:
        more = 5 if fault == C.CUT else 0
        own = [("D", 2, "")]
        if fault not in (C.BLANK, C.DUPLICATE):
            own += [("K", more, role[:1] or "?"), ("R", 1 + more, "u"), ("R", 1 + more, "a")]
        edits.append(own)
    gaps = [("", 0, ""), ("I", 5, "u"), ("I", 5, "a"), ("II", 10, "ua"), ("II", 10, "au")]
    for chosen in itertools.product(*edits):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            steps = [x for pair in zip(added, chosen) for x in pair] + [added[-1]]
            if grammar.match("".join(x[2] for x in steps)):
                found = (sum(x[1] for x in steps), "".join(x[0] for x in steps))
                best = found if best is None or found < best else best
    return best


def decoded(rows):
    d = C.Decoder()
    out = [e for role, fault in rows for e in d.add(role, "t", fault)] + d.end()
    return d.cost, "".join(e[0] for e in out), out


def test_repairs_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.randrange(4)) for _ in range(rng.randrange(5))]
        cost, audit, out = decoded(rows)
        assert (cost, audit) == cheapest(rows), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(e[1][:1] for e in out if e[0] != "D"))


def plain_viterbi(rows):
    """Whole strings per state, without pruning."""
    at = {C.NOTHING: (0, "")}
    for role, fault in rows:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        made = [[(at[s][0] + c, at[s][1] + x) for s, c, x in ways if s in at] for ways in C.MOVES[initial, fault]]
        at = {s: min(m) for s, m in enumerate(made) if m}
    ends = {C.NOTHING: "", C.ASSISTANT: "", C.USER: "I", C.SYSTEM: "II"}
    return min((c + 5 * len(ends[s]), x + ends[s]) for s, (c, x) in at.items())


def test_giving_up_states_loses_no_tie():
    rng = random.Random(8)
    for _ in range(3000):
        pool = rng.sample(["system", "user", "assistant", "tool"], rng.randrange(1, 5))
        rows = [(rng.choice(pool), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randrange(25))]
        cost, audit, _ = decoded(rows)
        assert (cost, audit) == plain_viterbi(rows), rows


def test_edits_leave_memory_as_survivors_meet():
    d, rng, most, n = C.Decoder(), random.Random(3), 0, 0
    for i in range(20_000):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[i % 2]
        n += len(d.add(role, "x", rng.choice([0, 0, 0, 1, 3])))
        most = max(most, len(d.rows))
    assert most < 200 and n + len(d.end()) >= 20_000


def brute_summary(rows, conv):
    """The contract's columns for one conversation, from its undamaged rows."""
    held = []
    for c, turn, role, text in rows:
        if c != conv:
            continue
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in held:
        tail = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append(C.BLANK if not tail else C.DUPLICATE if (role, text) in seen else C.OK if tail[-1] in ".!?" else C.CUT)
        seen.add((role, text))
    turns = {t for t, _, _ in held if t is not None}
    initials = [r[:1] for _, r, _ in held]
    cost, audit = plain_viterbi([(r, f) for (_, r, _), f in zip(held, faults)])
    out, at, state = [], 0, ""
    for letter in audit:
        state = {"": "u", "s": "u", "u": "a", "a": "u"}[state] if letter in "IR" else state
        if letter == "I":
            out.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = held[at]
        at += 1
        if letter == "R":
            out.append({"u": "user:", "a": "assistant:"}[state] + text)
        if letter == "K":
            state = role[:1]
            out.append(f"{role}:{text}")
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in (1, 2, 3)],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def odd_conversations():
    rng = random.Random(11)
    texts = ["Hi.", "Yes!", "no end", "", " \n", None, "Hi.", "Wie?\t", "x" * 50_000 + ".", "Ä."]
    rows = [(c if c else None, rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(texts))
            for c in range(60) for _ in range(rng.randrange(1, 9))]
    return rows + [(900, i % 500, ("user", "assistant")[i % 2], f"t{i % 700}.") for i in range(3000)]


def test_summaries_of_odd_conversations(spark):
    rows = odd_conversations()
    docs = spark.createDataFrame([(*r, 1, "z", False) for r in rows], CONV + ", place int, edit string, fault boolean").repartition(7)
    got = {r[0]: tuple(r) for r in C.summaries(C.damage(docs)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == brute_summary(rows, conv)


def test_repaired_rows_are_those_of_the_summary(spark):
    docs = C.damage(spark.createDataFrame(odd_conversations(), CONV))
    digest = {r.conv_id: (r.audit, r.repaired_sha256) for r in C.summaries(docs).collect()}
    by: dict = {}
    for r in sorted(C.repair(docs).collect(), key=lambda r: r.place):
        by.setdefault(r.conv_id, []).append(r)
    for conv, (audit, sha) in digest.items():
        own = by.get(conv, [])
        assert "".join(r.edit for r in own) == audit
        text = "\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == sha


def test_no_conversations(spark):
    none = spark.createDataFrame([], CONV)
    assert C.summaries(C.damage(none)).count() == 0 and C.repair(none).count() == 0


# ----------------------------------------------------------------------- sharding


def many_documents(spark, n=3000):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, "w " * rng.randrange(200) if i % 40 else None, "a", 1, 2, 3) for i in range(n)]
    rows += [(7, "copy " * 30, "hot", 1, 2, 3)] * (n // 2) + [(8, "long " * 20_000, "b", 1, 2, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(6), rows


def test_shards_are_near_equal_even_with_a_hot_record(spark, tmp_path):
    docs, rows = many_documents(spark)
    got = S.assign(docs, 6, str(tmp_path / "map")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    loads, places = Counter(), {}
    for r in got:
        loads[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.place)
    assert sorted(loads) == list(range(6))
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 6
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_rerun_gives_equal_shards(spark):
    docs, _ = many_documents(spark, 400)
    one, two = ({(r.doc_id, r["size"], r.shard, r.place) for r in S.assign(d, 5).where("virtual_slot <> 0").collect() if r.doc_id != 7}
                for d in (docs, docs.repartition(3)))
    assert one == two


def test_growth_edits_the_stored_map(spark, tmp_path):
    docs, _ = many_documents(spark)
    path = str(tmp_path / "map")
    rows = S.with_parts(S.records(docs))
    units = S.materialize(rows.groupBy("virtual_slot", "part").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes"), "units")
    first = S.write_map(S.first_map(units, 6), path, 1)
    second = S.write_map(S.rebalanced(first, units, 6), path, 2)
    third = S.write_map(S.rebalanced(second, units, 7), path, 3)
    key = ["virtual_slot", "part"]
    moved = second.withColumnRenamed("shard", "old").join(third, key).join(units, key).where("old <> shard").collect()
    loads = [r[1] for r in third.join(units, key).groupBy("shard").agg({"bytes": "sum"}).collect()]
    # Little more than the new shard's share moves, nearly all of it there.
    assert sum(r.bytes for r in moved) < 1.1 * sum(loads) / 7
    assert sum(r.bytes for r in moved if r.shard != 6) < 0.1 * sum(loads) / 7
    assert len(loads) == 7 and max(loads) - min(loads) < 0.02 * sum(loads) / 7
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2, 3}


def test_sharding_of_no_documents(spark):
    assert S.assign(spark.createDataFrame([], DOCS)).count() == 0


# ----------------------------------------------------------------- lexical search


def ranked(docs, queries, k):
    """The contract's ranking, document by document."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(d, Counter(cut(t))) for d, t in docs]
    n, words = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in queries:
        scores = []
        for d, c in terms:
            m = 50 + 50 * sum(c.values()) * n // max(words, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(cut(text)) if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, window, shard_docs, k", [(4, 16, 100, 5), (128, 2048, 1 << 16, 50), (2, 7, 40, 1)])
def test_ranking_is_exact(spark, tmp_path, monkeypatch, block, window, shard_docs, k):
    rng = random.Random(block)
    vocabulary = ["the", "Of", "rare", "ÄÖ", "x1", "β"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(vocabulary, [40, 20, 1, 2, 3, 1, *[1] * 40], k=rng.randrange(30)))) for i in range(700)]
    docs += [(i, "the rare copy. of the") for i in range(700, 900)] + [(5, "rare"), (None, "rare x1"), (901, None), (902, ""), (903, "... !")]
    docs += [(904, "word the " * 30_000)]
    rng.shuffle(docs)
    queries = [(0, "The rare of"), (1, "w1 w2, w3 the of"), (1, "ÄÖ β x1"), (2, None), (3, "-"), (4, "unseen"), (None, "rare rare copy")]
    # The settings are read in the tasks, which import the module anew.
    for name, value in (("BLOCK", block), ("WINDOW", window), ("SHARD_DOCS", shard_docs)):
        monkeypatch.setattr(L, name, value)
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, shard int, term int").repartition(5)
    path = str(tmp_path / "index")
    L.write_index(table, path)
    got = L.search(spark, path, spark.createDataFrame(queries, "item_id long, text string"), k)
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=str) == ranked(docs, queries, k)


def test_blocks_of_hopeless_candidates_stay_packed():
    """One shard in this process: a document that two lists could only lift with a good block is given up unopened."""
    import pyarrow as pa

    texts = ["rare common"] * 60 + ["common " + "pad " * 400] * 4000 + ["rare " + "pad " * 50] * 10
    rows = [r for b in L.invert(0, list(range(len(texts))), [L.occurrences(pa.array(texts, pa.large_string()))]) for r in b.to_pylist()]
    totals = L.Totals(len(texts), sum(len(t.split()) for t in texts))
    m = totals.m(L.np.array(rows[0]["lengths"]))
    shard = L.Shard(rows[0]["ids"], m, {r["term"]: L.Postings(r, m, totals) for r in rows[1:]})
    rare, common = (L._query_terms([(0, t)])[0][0] for t in ("rare", "common"))
    top = shard.top([(rare, 5000), (common, 10)], 50, 0)
    assert [at for _, at in top] == list(range(50))
    opened = shard.lists[common].open
    assert opened.sum() <= L.WINDOW // L.BLOCK + 1 < opened.size


def test_search_with_no_documents_and_no_queries(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    L.write_index(docs, str(tmp_path / "none"))
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.search(spark, str(tmp_path / "none"), some).count() == 0
    L.write_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(tmp_path / "one"))
    assert L.search(spark, str(tmp_path / "one"), some.limit(0)).count() == 0


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    import numpy as np

    from granary.llm import jaccard_join

    rng = np.random.default_rng(5)
    for n, gone, new in ((1, 0, 0), (1, 0, 40), (50, 3, 2), (400, 10, 900), (5000, 800, 0), (5000, 60, 60)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard_join.parity_sketch(v), np.uint8) for v in (x, y))
        bits = jaccard_join.sketch_distance(a, b)
        assert bits == jaccard_join.sketch_distance(b, a) <= np.setxor1d(x, y).size
        assert (bits == 0) == (gone + new == 0)
