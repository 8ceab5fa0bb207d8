"""Personal data: fixed patterns for four kinds, and contexts learned from what those find.

Base spans of emails, IP addresses, card and phone numbers seed a graph. Its nodes are
these spans, each as a whole, and other identifier-like words (instances), and the words around them (patterns). A pattern is as
trustworthy as the share of its instances that are known to be personal, an instance as the
patterns that hold it; both are scored in turns over the whole corpus. Words that stand in a
pattern of high confidence are further spans. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match starts where the one before it ended or where no earlier start could have led to it;
#: that finds what the plain patterns find, leftmost first, in linear time.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Whole runs of digits with single separators, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words with a digit or an at sign.
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Characters around an identifier that are not part of it.
OPENING, CLOSING = "\"'(<[{", ".,;:!?)>]}\"'"
CONTEXT_CHARS = 80

ROUNDS = 3
#: Different seed instances that a pattern needs, and the share of its instances that must be known.
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.9


def _octet(x: Column) -> Column:
    number = F.ltrim(x, F.lit("0"))
    return (F.length(number) <= 2) | ((F.length(number) == 3) & (number <= "255"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


#: What a match of each kind must fulfil besides its pattern.
_RIGHT: tuple[Callable[[Column], Column], ...] = (
    lambda x: F.lit(True),
    lambda x: F.forall(F.split(x, r"\."), _octet),
    lambda x: F.call_function("luhn_check", _digits(x)),
    lambda x: F.length(_digits(x)).between(8, 15),
)


def _cut(docs: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add, per name, the array of ``(start, end, word, before, after)`` of each match in ``text``.

    With each pattern comes a cheap necessary condition. Matches, the texts between them and
    the places are columns of steps of their own, so each pattern runs twice per text, not once per use.
    """
    empty = F.array().cast("array<string>")
    out = docs.withColumns({
        f"{k}_words": F.when(near, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(empty) for k, (p, near) in patterns.items()})
    out = out.withColumns({
        f"{k}_gaps": F.when(F.size(f"{k}_words") > 0, F.split("text", p, -1)).otherwise(empty) for k, (p, _) in patterns.items()})
    out = out.withColumns({
        f"{k}_ends": F.aggregate(
            F.zip_with(f"{k}_words", F.slice(f"{k}_gaps", F.lit(1), F.size(f"{k}_words")), lambda w, g: F.length(w) + F.length(g)),
            F.array(F.lit(0)), lambda at, n: F.array_append(at, F.element_at(at, -1) + n))
        for k in patterns})

    def spans(k: str) -> Column:
        words, gaps, ends = (F.col(f"{k}_{x}") for x in ("words", "gaps", "ends"))
        return F.transform(words, lambda w, i: F.struct(
            (F.get(ends, i + 1) - F.length(w)).alias("start"), F.get(ends, i + 1).alias("end"), w.alias("word"),
            F.concat(F.when(i > 0, F.get(words, i - 1)).otherwise(""), F.get(gaps, i)).alias("before"),
            F.get(gaps, i + 1).alias("after")))

    return out.withColumns({k: spans(k) for k in patterns}).drop(*[f"{k}_{x}" for k in patterns for x in ("words", "gaps", "ends")])


def _right(kind: int, found: str) -> Column:
    return F.filter(found, lambda s: _RIGHT[kind](s.word))


def _base(kind: int, found: str) -> Column:
    """Matches of a kind that are right, as ``(kind, start, end)``."""
    return F.transform(
        _right(kind, found),
        lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))


def _around(found: Column, trim: bool) -> Column:
    """Matches with their place and their patterns: two words before, or one on each side. ``trim`` takes marks off their ends."""

    def words(x: Column) -> Column:
        plain = F.regexp_replace(F.lower(x), "[0-9]", "0")
        return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda y: y != "")

    def one(s: Column) -> Column:
        lead = F.length(s.word) - F.length(F.ltrim(s.word, F.lit(OPENING))) if trim else F.lit(0)
        core = F.rtrim(F.ltrim(s.word, F.lit(OPENING)), F.lit(CLOSING)) if trim else s.word
        left = words(F.substring(s.before, -CONTEXT_CHARS, CONTEXT_CHARS))
        right = words(F.substring(s.after, 1, CONTEXT_CHARS))
        w1, w2, r1 = (F.coalesce(F.try_element_at(a, F.lit(i)), F.lit("")) for a, i in ((left, -1), (left, -2), (right, 1)))
        return F.struct(
            (s.start + lead).alias("start"), (s.start + lead + F.length(core)).alias("end"), core.alias("word"),
            F.array(F.concat_ws(" ", w2, w1, F.lit("_")), F.concat_ws(" ", w1, F.lit("_"), r1)).alias("patterns"))

    return F.filter(F.transform(found, one), lambda c: c.end > c.start)


def scan(docs: DataFrame) -> DataFrame:
    """``row_id``, ``doc_id``, ``base`` spans and ``words`` with contexts of each row, written once."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    near = (F.contains(text, F.lit("@")), digit & F.contains(text, F.lit(".")), digit, F.contains(text, F.lit("+")))
    patterns = dict(zip(KINDS, zip((EMAIL, IP, CARD, PHONE), near))) | {"words": (IDENTIFIER, text.rlike("[0-9@]"))}
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    cut = _cut(rows, patterns)
    # A base span is one instance, whatever spaces it has; identifier-like words are instances where no base span is.
    seeds = [_around(_right(i, k), False) for i, k in enumerate(KINDS)]
    found = cut.select(
        "row_id", "doc_id", F.concat(*[_base(i, k) for i, k in enumerate(KINDS)]).alias("base"), F.concat(*seeds).alias("spans"),
        _around(F.col("words"), True).alias("words"))
    overlap = lambda b, w: (b.start < w.end) & (b.end > w.start)
    apart = F.filter("words", lambda w: ~F.exists("base", lambda b: overlap(b, w)))
    known = F.transform(F.concat("spans", apart), lambda w: F.struct(
        w.start.alias("start"), w.end.alias("end"), w.word.alias("word"), w.patterns.alias("patterns"),
        F.filter("base", lambda b: overlap(b, w)).alias("seeds")))
    return materialize(found.withColumn("words", known).drop("spans"), "pii-scan")


def score_patterns(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                   min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pattern``, ``kind`` and ``confidence`` of the trusted patterns.

    The graph holds each (pattern, word) once, however often the pair occurs, so copies of a text add
    nothing. A seed's score is 1. In each round a pattern gets the mean score of its words, and other words
    get the mean over all their patterns of what trusted patterns score. Sums combine before the
    shuffle; joins are plain equi joins, whose hot keys adaptive execution splits.
    """
    each = scanned.select(F.explode("words").alias("w")).select(
        F.explode("w.patterns").alias("pattern"), F.col("w.word").alias("word"),
        F.get("w.seeds", F.lit(0)).getField("kind").alias("kind"))
    edges = materialize(each.groupBy("pattern", "word").agg(F.min("kind").alias("kind")), "pii-graph")
    seeds = edges.groupBy("word").agg(F.min("kind").alias("seed"))
    scores = materialize(seeds.select("word", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"), F.col("seed")), "pii-words")
    by_kind = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_kind.groupBy("pattern").agg(F.sum("n").alias("n_seeds"), F.max_by("kind", F.struct(F.col("n"), -F.col("kind"))).alias("kind"))
    kinds = kinds.where(F.col("n_seeds") >= min_seeds)
    trusted = None
    for i in range(rounds):
        mean = edges.join(scores, "word").groupBy("pattern").agg(F.avg("score").alias("confidence"))
        trusted = materialize(mean.where(F.col("confidence") >= min_confidence).join(kinds, "pattern").select("pattern", "kind", "confidence"), "pii-patterns")
        if i + 1 < rounds:
            held = edges.join(trusted.select("pattern", "confidence"), "pattern", "left").groupBy("word").agg(
                F.avg(F.coalesce("confidence", F.lit(0.0))).alias("score"))
            scores = materialize(
                held.join(scores.select("word", "seed"), "word").select(
                    "word", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"), "seed"), "pii-words")
    return trusted


def find(docs: DataFrame, **settings: float) -> DataFrame:
    """``doc_id``, ``base`` and ``all`` spans, arrays of ``(kind, start, end)``, per row of ``docs``.

    Starts and ends count code points, ends are exclusive. A null text is empty and has no spans. Learned
    spans never overlap base spans; their kind is the one most seeds of the pattern have. Repeated rows
    and repeated or null doc_ids are kept apart by row. Other columns are not read. Learning sees all rows.
    """
    scanned = scan(docs)
    trusted = score_patterns(scanned, **settings)
    open_words = scanned.select("row_id", F.explode("words").alias("w")).where(F.size("w.seeds") == 0).select(
        "row_id", "w.start", "w.end", F.explode("w.patterns").alias("pattern"))
    more = open_words.join(trusted, "pattern").groupBy("row_id", "start", "end").agg(
        F.max_by("kind", F.struct(F.col("confidence"), -F.col("kind"))).alias("kind"))
    more = more.groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return scanned.join(more, "row_id", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", nothing))).alias("all"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
