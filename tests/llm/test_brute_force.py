"""Operators against plain Python on small awkward tables: nulls, empty and long texts, ties,
repeated rows, clashing extra columns, and tables without rows."""

import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import (
    components, decontaminate, jaccard_join, language_id, mixing, pii, quality_rules, suffix_dedup, token_counts,
    token_files, warc,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("row_id", T.StringType()), T.StructField("n_words", T.StringType()),
    T.StructField("tokens", T.LongType()),
])


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "de", "ki", "lo", "mu", "né", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    far = " ".join(words[:60] + prose(2, 60).split(" "))
    texts = [
        base, base, near, far, base.upper(), None, "", "   \n\t", "one two", "One  TWO", "one two three", prose(3, 30) + "\n" + base,
        prose(4, 20_000), "x" * 5000, "a b c d " * 60, "line one\nline one\n\nline one", "😀 é\x1cz <|endoftext|> don't  do", base,
    ]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3], f"r{i}", "w", 7) for i, t in enumerate(texts)]
    return out + [out[0], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# ------------------------------------------------------------------------------- quality


def test_rules(docs, empty):
    def measure(t):
        w, lines = WORDS.findall(t or ""), [x for x in (t or "").split("\n") if WORDS.search(x)]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))

    got = quality_rules.add_ledger(docs).select("doc_id", "ledger.*", "n_words")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ledger = quality_rules.add_ledger(docs, out="own").select("doc_id", *[F.col(f"own.{n}").alias(n) for n in names])
    assert bag(ledger, "doc_id", *names) == collections.Counter((r[0], *measure(r[1])) for r in rows())
    assert got.count() == docs.count()
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 11, 12, 17, None}
    assert quality_rules.keep(empty).count() == 0


def test_ablations(spark):
    ledger = spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (4,)], "fail_bits long")
    got = {(r.policy, r.rule): r for r in quality_rules.ablations(ledger).collect()}
    short = got["base", "too_short"]
    assert (short.n_docs, short.n_rejected, short.n_failed, short.n_only_this, short.n_kept_without) == (6, 4, 3, 1, 3)
    assert got["v1", "symbols"].n_only_this == 1
    assert quality_rules.ablations(ledger.where("false")).count() == 0


# -------------------------------------------------------------------------- suffix arrays


@pytest.mark.parametrize("shard", [1, 1024])
def test_repeated_bytes(docs, empty, shard):
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen = collections.Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want[i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.dedup(docs, shard_contexts=shard)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    whole = suffix_dedup.dedup(docs, kept=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in whole)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_array():
    import numpy as np

    from granary.llm.suffix_array import neighbours, permuted_lcp, suffix_array

    rng = np.random.default_rng(3)
    for trial in range(150):
        s = rng.integers(1, rng.choice([2, 3, 9, 250]), rng.integers(1, 150))
        s = np.append(np.tile(s, 1 + trial % 4), 0)
        sa, b = suffix_array(s), s.tolist()
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        limit = len(b) - 1 - np.arange(len(b))
        other = neighbours(sa)
        for i, n in enumerate(permuted_lcp(s, other, limit).tolist()):
            j = int(other[i])
            if j >= 0:
                assert b[i : i + n] == b[j : j + n] and (n == min(limit[i], limit[j]) or b[i + n] != b[j + n])


# ------------------------------------------------------------------------------------ PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    right = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if right[k](m[0])]


def test_base_spans(spark, empty):
    texts = [
        "é a@b.co, c.d@e-f.g.h_x@y.z and a@b a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112",
        "4111111111111111-9 x4111111111111111y 12 34", "+1 (555) 010-2030 +123 +12345678) +1-2-3-4-5-6-7-8.", "😀 +49 30 1234567, me@x.org", "", None,
        "a" * 3000 + "@" + "b" * 3000, "0000000000000000", "1.1.1.1" * 50,
    ]
    rng = random.Random(5)
    texts += ["".join(rng.choice("a1 .@-+(2é)") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.joined(F.col("base")).alias("s")).collect()}
    assert got == {i: ",".join(base_spans(t)) for i, t in enumerate(texts)}
    assert pii.find(empty).count() == 0


def learned(spark, texts, **settings):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.find(df, **settings).select("doc_id", pii.joined(F.array_except("all", "base")).alias("s"))
    return {r.doc_id: r.s for r in found.collect() if r.s}


def test_contexts_are_learned(spark):
    texts = [f"please write to user{i}@mail.org for details number {i}" for i in range(20)]
    texts += ["please write to badge-7781x for details", "the street number 12 is here", "please write to badge-7781x for details"]
    at = texts[20].index("badge")
    assert learned(spark, texts) == {i: f"email:{at}:{at + 11}" for i in (20, 22)}
    assert learned(spark, texts, min_confidence=0.97) == {}


def test_unseen_identifiers_beside_learned_contexts(spark):
    """Whole entities with spaces seed patterns around themselves: precision and recall on planted identifiers."""
    rng = random.Random(9)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"you can call him on +49 {number(2)} {number(7)} after lunch" for _ in range(60)]
    texts += [f"paid by card no 4111 1111 1111 1111 on day {i}" for i in range(5)]
    texts += [f"the host at 10.0.{i}.{i + 1} went down" for i in range(60)]
    planted = {}
    for context, kind in (("you can call him on {} after lunch", "phone"), ("the host at {} went down", "ip")):
        for word in (f"ext-{number(4)}", f"srv{number(3)}.local", f"{number(5)}x"):
            planted[len(texts)] = f"{kind}:{context.index('{')}:{context.index('{') + len(word)}"
            texts.append(context.format(word))
    texts += [f"chapter {i} has {number(3)} pages and item {number(2)}b" for i in range(60)]
    got = learned(spark, texts)
    right = sum(got.get(i) == s for i, s in planted.items())
    assert right >= 0.9 * len(planted) and right >= 0.9 * len(got)


# ---------------------------------------------------------------------------- language id


def test_language(spark, empty):
    rng = random.Random(7)
    words = {"aa": ["the", "and", "with", "thing"], "bb": ["der", "und", "nicht", "über"], "cc": ["le", "était", "où", "que"]}
    data = [(i, " ".join(rng.choices(words[k], k=60)), k) for i, k in enumerate(rng.choices(list(words), k=240))]
    data += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (None, "the and with", None), (903, "the " * 20_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = language_id.fit(df)
    got = df.withColumn("p", language_id.predict(df, net, F.col("text"))).withColumn("out", language_id.held_out(F.col("doc_id")))
    found = got.collect()
    for r in found:
        if r.doc_id is not None:
            assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.p.score <= 1
    held = [r for r in found if r.out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 20 and sum(r.p.lang == r.lang for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r.p.lang for r in found}
    assert by_id[900] == by_id[901] == by_id[902] == "und" and by_id[903] == by_id[None] == "aa"
    assert language_id.fit(empty) is None
    none = df.withColumn("p", language_id.predict(df, None, F.col("text")))
    assert {r.p.lang for r in none.collect()} == {"und"}


# ---------------------------------------------------------------------------- token files


def test_tokens(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_files.vocabulary_path())
    want = collections.Counter()
    for r in rows():
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[r[0], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path)
    got = token_files.token_starts(spark, path).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    some = token_files.read_tokens(spark, path, (3, 5))
    assert {r.doc_id for r in some.collect()} == {3, 4, 5}
    token_files.write_tokens(empty, str(tmp_path / "none"))
    assert token_files.token_starts(spark, str(tmp_path / "none")).count() == 0


def test_pieces_encode_as_whole_texts():
    """The added token's text among neighbours of every kind, and all places where white space meets."""

    from tokenizers import Tokenizer

    plain, made = Tokenizer.from_file(token_files.vocabulary_path()), token_files.encoder(token_files.vocabulary_path())
    rng = random.Random(4)
    parts = ["<|endoftext|>", "x", "Wort", "é", " ", " ", "  ", "\n", "\t", "\x1c", "\u2003", "\xa0", "\x85", "'s", "12", "😀", ".", "<|", "\u3000"]
    texts = ["", " ", "<|endoftext|>", "x <|endoftext|> y", "x<|endoftext|>y z", "a  <|endoftext|>", "<|endoftext|> b c", "w " * 5000 + "e"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    for lo in range(0, len(texts), 700):
        some = texts[lo : lo + 700]
        for t, ids in zip(some, made(some)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_file_format(docs, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_tokens(docs, str(tmp_path / "t"))
    for f in (tmp_path / "t").glob("part-*"):
        for g in range(pq.ParquetFile(f).metadata.num_row_groups):
            columns = [pq.ParquetFile(f).metadata.row_group(g).column(i) for i in range(3)]
            assert any("DELTA" in e for e in columns[0].encodings) and columns[0].has_column_index
            assert any("DICTIONARY" in e or "DELTA" in e for e in columns[2].encodings)


# --------------------------------------------------------------------------------- mixing


def test_mixture(spark, docs, empty):
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows())
    sizes = collections.defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = total - sum(3 * sizes[s] for s in capped)
        level = {s: free * weights[s] / sum(weights[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s, t in level.items() if t > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3.0 * sizes[s] if s in capped else level[s] for s in names}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * total
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    mixed = bag(mixing.mix(docs), "doc_id", "source", "row_id")
    once = collections.Counter({(r.doc_id, r.source): 0 for r in got})
    for r in got:
        once[r.doc_id, r.source] += r.copies
    flat = collections.Counter()
    for (i, s, _), n in mixed.items():
        flat[i, s] += n
    assert +flat == +once and mixing.mix(docs).columns == docs.columns
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixture_comes_near_targets_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 5)
    df = spark.range(900).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as source", "repeat('w ', cast(id % 40 as int)) as text")
    got = mixing.copies(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in got)
    assert sorted(mixing.copies(df).collect()) == sorted(mixing.copies(df).collect())


# --------------------------------------------------------------------------- Jaccard join


def test_jaccard(docs, empty):
    def shingles(t):
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    own = [(r[0], shingles(r[1])) for r in rows()]
    root = list(range(len(own)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(own):
        for j, (_, b) in enumerate(own[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(own):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    want = collections.Counter((d, len(s), low.get(top(i))) for i, (d, s) in enumerate(own))
    got = jaccard_join.join(docs.withColumn("row_id", F.monotonically_increasing_id()))
    assert bag(got, "doc_id", "n_shingles", "component_id") == want
    one = jaccard_join.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len({top(i) for i in range(len(own))})
    assert jaccard_join.keep_one(empty).count() == 0


def test_jaccard_of_chains_in_small_blocks(spark, monkeypatch):
    # Each text differs a little from the next, so components are chains and no leader is near to all.
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    words, texts = prose(9, 80).split(" "), []
    for i in range(40):
        words = words[:i] + [f"new{i}"] + words[i + 1 :]
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts + [(100, prose(10, 80))], "doc_id long, text string").withColumn("row_id", F.col("doc_id"))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100}


def linked_by_brute_force(texts, k, percent):
    """Smallest id of each component, all pairs compared."""
    sets = {}
    for i, t in texts:
        w = t.split(" ")
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            u, v = sorted((top(a), top(b)))
            root[v] = u
    return {i: top(i) for i in sets}


def edited(base, edits, seed):
    """``base`` with ``edits`` words replaced by new ones, in places of their own."""
    rng, out = random.Random(seed), base.split(" ")
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"e{seed}x{i}"
    return " ".join(out)


@pytest.mark.parametrize("crowd", [1, 3, 1000])
def test_jaccard_of_crowds(spark, monkeypatch, crowd):
    # Copies with few and with many edits of their own, and bystanders that share a passage with them.
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    base, texts = prose(31, 150), []
    for edits in (0, 1, 2, 3, 4, 5, 6, 9):
        texts += [edited(base, edits, 100 * edits + j) for j in range(5)]
    half = " ".join(base.split(" ")[:75])
    texts += [half + " " + prose(400 + j, 75) for j in range(6)]
    texts = list(enumerate(texts))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row_id", F.col("doc_id"))
    want = linked_by_brute_force(texts, 4, 85)
    assert 1 < len(set(want.values())) < len(texts)
    assert {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()} == want


@pytest.mark.parametrize("edits", [1, 12])
def test_large_groups_open_no_blocks(spark, monkeypatch, edits):
    # Copies linked with a representative, and copies too far apart: neither are compared pair by pair.
    opened, whole = [], jaccard_join._opened
    monkeypatch.setattr(jaccard_join, "_opened", lambda *a: (opened.append(whole(*a)), opened[-1])[1])
    base = prose(77, 200)
    texts = [(j, edited(base, edits, j)) for j in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row_id", F.col("doc_id"))
    got = {r.doc_id: r.component_id for r in jaccard_join.join(df).collect()}
    assert got == {j: 0 if edits == 1 else j for j in range(150)}
    assert opened[0].count() <= 5


def test_pipeline_stage_merges_from_eighty_percent_of_five_words(spark):
    import corpus_pipeline

    texts, n = [], 0

    def pair(a, b):
        nonlocal n
        texts.extend([(2 * n, a), (2 * n + 1, b)])
        n += 1

    for k in range(30, 65, 5):  # from 0.87 down to 0.75 of five words
        base = prose(100 + k, 200)
        pair(base, base + " " + prose(200 + k, k))
    for step in (40, 45, 47, 49, 60):
        words = prose(300 + step, 400).split(" ")
        pair(" ".join(words), " ".join(w if (i + 1) % step else f"x{i}" for i, w in enumerate(words)))
    pair("one two three four", "One two  three FOUR")
    pair("one two three", "one two three five")

    def shingles(t):
        w = WORDS.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(t) for _, t in texts]
    share = {i: len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in range(1, 2 * n, 2)}
    assert sum(0.80 <= s < 0.85 for s in share.values()) >= 3 and min(share.values()) < 0.8
    want = {i for i, _ in texts if i % 2 == 0 or share[i] < 0.8}
    got = corpus_pipeline.one_of_similar(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 100), (7, 7), (200, 101), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 105, 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ----------------------------------------------------------------------------------- WARC


@pytest.fixture
def pages(spark):
    long = "<p>é" * 700
    data = [(1, "u1", long), (2, "u2", long), (3, None, "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (2, "u2", long),
            (None, "u7", long), (8, "u\r\nX: y", "WARC/1.1\r\n\r\n\r\n" * 400), (9, "u9", "z" * 1000), (10, "u10", "z" * 999 + "é" * 9000)]
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit(1))


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_warc(spark, pages, tmp_path, segment):
    path = str(tmp_path / "warc")
    warc.write_warc(warc.plan_records(pages), path, segment=segment, chunk=37)
    got = warc.read_warc(spark, path).collect()
    origin = {}
    for r in pages.collect():
        data = (r.html or "").encode()
        if len(data) >= 1000 and r.page_id is not None:
            origin[data] = max(origin.get(data, r.page_id), r.page_id)
    want = collections.Counter()
    for r in pages.collect():
        data = (r.html or "").encode()
        to = origin.get(data)
        again = to is not None and to != r.page_id
        want[r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        assert r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes


def test_damaged_segments_fail(spark, pages, tmp_path):
    import gzip
    import io

    whole = b"".join(r + warc.END for r in warc.records(1, "u", b"x" * 500, hashlib.sha1(b"x" * 500).hexdigest(), "response", None, "k", 100, 50))
    records = [(f, b) for f, b in warc.parse(io.BytesIO(whole))]
    assert len(records) > 3 and records[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in records))
    parts = [x for x in whole.split(b"WARC/1.1") if x]
    for name, broken in {"missing": parts[:2] + parts[3:], "no_end": parts[:-1]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gz").write_bytes(gzip.compress(b"".join(b"WARC/1.1" + p for p in broken)))
        with pytest.raises(Exception, match="do not add up"):
            warc.read_warc(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunked(b"5\r\nabcdeXX0\r\n\r\n")
    warc.write_warc(warc.plan_records(pages.where("false")), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# ------------------------------------------------------------------------- decontamination


def test_leaks(spark, docs, empty):
    items = [(i, prose(50 + i, 40)) for i in range(5)] + [(7, None), (8, ""), (9, "ab"), (None, prose(77, 40))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = items[1][1].split(" ")
    edited = " ".join(w if k % 9 else "other" for k, w in enumerate(words))
    gaps = " ".join(w for k, w in enumerate(words) if k % 10)
    texts = [
        (1, prose(60, 90) + " " + items[0][1] + " " + prose(61, 90)), (2, edited + " " + prose(62, 50)), (3, gaps), (4, prose(63, 300)),
        (5, None), (6, items[2][1].replace("b", "B").replace(" ", ", ") + ". " + items[3][1]), (7, " ".join(words[:8]) + " " + prose(64, 80)), (8, items[8][1]),
        (1, items[0][1]),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("leaks_0", F.lit("own"))
    found = decontaminate.add_leaks(df, benchmark).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in found) == {(1, 0): 2, (2, 1): 1, (3, 1): 1, (6, 2): 1, (6, 3): 1, (8, None): 1}
    exact = next(r for r in found if r.doc_id == 1 and r.first_word > 0)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 90, 129)
    kept = decontaminate.clean(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 7]
    assert decontaminate.clean(docs, benchmark.where("false")).count() == docs.count()
    assert decontaminate.clean(empty, benchmark).count() == 0


def test_items_come_in_blocks(spark):
    benchmark = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], "item_id long, text string")
    parts = list(decontaminate.blocks(benchmark, 500))
    assert len(parts) > 3 and sorted(i for p in parts for i, _ in p) == list(range(20))


def test_many_blocks_find_what_one_block_finds(spark, docs):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j} the of" for j in range(9))) for i in range(12)] + [(99, "a b")], "item_id long, text string")
    texts = docs.unionByName(items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), "text", F.lit(" after")).alias("text")),
                             allowMissingColumns=True)
    key = lambda d: collections.Counter((r.doc_id, r.text, tuple(sorted(map(tuple, r.leaks)))) for r in d.collect())
    one, many = decontaminate.add_leaks(texts, items), decontaminate.add_leaks(texts, items, block_bytes=400)
    assert key(one) == key(many) and sum(len(r.leaks) for r in one.collect()) >= 12
    assert one.columns == many.columns


def test_alignment():
    import numpy as np

    def plain(a, b):
        best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
                table[i][j] = max(0, table[i - 1][j - 1] + s, table[i - 1][j] + decontaminate.GAP, table[i][j - 1] + decontaminate.GAP)
                best = max(best, table[i][j])
        return best

    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 15))] for _ in range(2))
        score, first, last = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
        assert score == plain(a, b) and (score == 0 or plain(a, b[first : last + 1]) == score)


@pytest.mark.parametrize("step", [2, 3, 4, 5, 6, 7, 8])
@pytest.mark.parametrize("exact", [0, 1])
def test_leaks_with_dense_edits(spark, step, exact):
    # Nothing but the alignment decides: no rarity and no length of a seed may keep an edited copy from it.
    words = prose(50, 40).split(" ")
    edits = {
        "changed": lambda k, w: [w] if k % step else [f"x{k}"], "missing": lambda k, w: [w] if k % step else [],
        "added": lambda k, w: [w] if k % (step - 1) else [w, f"x{k}"],
    }
    texts = [(0, " ".join(words))] * exact
    for i, edit in enumerate(edits.values(), 1):
        copy = " ".join(x for k, w in enumerate(words) for x in edit(k, w))
        texts += [(10 * i + j, f"{prose(60 + j, 30)} {copy} {prose(70 + j, 30)}") for j in range(3)]
    texts.append((99, prose(80, 200)))
    want = {i for i, t in texts if aligned(words, t.split(" ")) >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(words)}
    assert len(want) >= 3 and 99 not in want
    df = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, prose(51, 40))], "item_id long, text string")
    found = decontaminate.add_leaks(df, benchmark).select("doc_id", F.explode("leaks.item_id").alias("i")).collect()
    assert {(r.doc_id, r.i) for r in found} == {(i, 1) for i in want}


def test_every_accepted_passage_has_its_seeds():
    import numpy as np
    import pyarrow as pa

    from granary.llm import bytes_np

    rng, accepted = random.Random(11), 0
    for _ in range(1500):
        item = [rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 14))]
        copy = []
        for x in item:
            copy += rng.choices([[x], ["z"], [], [x, "y"], [x, "y", "z"]], [6, 1, 1, 2, 1])[0]
        text = rng.choices("abcxyz", k=5) + copy + rng.choices("abcxyz", k=5)
        items = decontaminate.index_items([(1, " ".join(item))])
        w = bytes_np.words(*bytes_np.text_bytes(pa.array([" ".join(text)])), separator=decontaminate.SEPARATOR)
        at, word = decontaminate._hits(w, items, items.sieves())
        need, span = decontaminate.bounds(np.array([len(item)]), decontaminate.MIN_SCORE)
        best = max((decontaminate.align(items.words[0], w.hash[max(0, a) : b + 1])[0] for _, a, b in
                    decontaminate._passages(at, word, w.row[word], need, span)), default=0)
        score = aligned(item, text)
        if score >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(item):
            accepted += 1
            assert best == score
    assert accepted > 300


def aligned(a, b):
    """Best local alignment score of two lists of words."""
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            s = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            row.append(max(0, above[j - 1] + s, above[j] + decontaminate.GAP, row[-1] + decontaminate.GAP))
        best, above = max(best, *row), row
    return best


# ---------------------------------------------------------------------------- token counts


def test_rollup(spark, empty, tmp_path):
    columns = "source string, lang string, tokenizer string, op string, tokens long, old_tokens long"
    one = spark.createDataFrame([("s", "l", "t", "insert", 5, None), (None, None, "t", "insert", 2, None), ("s", "l", "t", "insert", 5, None)], columns)
    two = spark.createDataFrame([("s", "l", "t", "revise", 9, 5), (None, None, "t", "delete", 2, None)], columns)
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.commit("1", one) and rollup.commit("2", two) and not rollup.commit("2", two)
    assert bag(rollup.totals(["1", "2", "3"]), "source", "lang", "tokenizer", "n_docs", "n_tokens") == {("s", "l", "t", 2, 14): 1}
    assert rollup.compact(["1", "2"], "1-2") and bag(rollup.totals(["1-2"]), "n_docs", "n_tokens") == {(2, 14): 1}
    # A batch that broke off has no marker, does not count, and is written anew.
    broken = tmp_path / "r" / "batch=4"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert rollup.totals(["1", "2", "4"]).count() == 1 and rollup.commit("4", one)
    assert bag(rollup.totals(["1", "2", "4"]), "n_docs", "n_tokens") == {(4, 24): 1, (1, 2): 1}
    with pytest.raises(ValueError):
        rollup.commit("../x", one)
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("5", one.withColumn("op", F.lit("move")))
    assert rollup.commit("6", one.where("false")) and rollup.totals([]).count() == 0


def test_counts_by_version(docs):
    counted = token_counts.counted(docs, {"a": F.length("text"), "b": F.lit(2)})
    assert counted.count() == 2 * docs.count() and counted.where("tokens is null").count() == 0
