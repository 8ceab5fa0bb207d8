"""SQL counterparts that DuckDB runs on the same tables."""

from __future__ import annotations

from granary.llm.mixing import MAX_COPIES

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 7]) AS n FROM g),
c AS (SELECT r, count(*) AS n_repeat_words FROM
        (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM h WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END
        AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, CAST(bits AS BIGINT) AS fail_bits,
  (bits & 3) <> 0 AS base_failed, bits = 0 AS kept FROM b
"""

ORACLES["op6_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, encode(source)) AS r FROM p),
l AS (SELECT *, (SELECT sum(source_size) FROM o) - {MAX_COPIES} * coalesce(sum(source_size) OVER b, 0) AS l,
        (SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER b, 0) AS w FROM o
        WINDOW b AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {MAX_COPIES} * source_size * w <= l * weight AS capped FROM l),
f AS (SELECT * FROM c WHERE NOT capped ORDER BY r LIMIT 1),
t AS (SELECT c.source, c.source_size, CASE WHEN c.capped THEN CAST({MAX_COPIES} * c.source_size AS DOUBLE)
        ELSE c.weight * CAST((SELECT l FROM f) AS DOUBLE) / CAST((SELECT w FROM f) AS DOUBLE) END AS target FROM c),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, key) AS DOUBLE) AS k FROM d),
u AS (SELECT k.doc_id, k.size, t.source_size, t.target, k.k,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST(('0x' || left(md5('mix' || coalesce(k.source, '')), 8)) AS BIGINT) / 4294967296.0 AS offs
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(k * rate + offs) - floor((k - 1) * rate + offs)) AS BIGINT) AS taken FROM u
"""

ORACLES["op10_token_counts"] = r"""
WITH d AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
k AS (SELECT source, lang, text FROM d WHERE text IS NULL OR NOT coalesce(doc_id > first_id, false)),
c AS (SELECT source, lang, 'words' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM k
  UNION ALL SELECT source, lang, 'words_marks',
        len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\x5B-`{-~]')) FROM k)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""

ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS origin FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM origin AND origin IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""

# Pairs come from shared shingles; components from repeated minima over the links.
ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])
        ELSE [w] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""

# A checksum byte by byte, through the table of its 256 remainders.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1
        THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n))"""


def _crc32(text: str) -> str:
    data = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || {data}[2 * i + 1:2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295)"


# One row per conversation, place and state: the best way there. Moves of a row come after any rows inserted before it.
ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(
    "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN ''
        WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(was, label, cost, upto, added) AS (VALUES ('e', '', 0, 'e', []), ('s', '', 0, 's', []), ('u', '', 0, 'u', []), ('a', '', 0, 'a', []),
        ('e', 'I', 5, 'u', ['user:']), ('s', 'I', 5, 'u', ['user:']), ('a', 'I', 5, 'u', ['user:']), ('u', 'I', 5, 'a', ['assistant:']),
        ('e', 'II', 10, 'a', ['user:', 'assistant:']), ('s', 'II', 10, 'a', ['user:', 'assistant:'])),
step(upto, letter, cost, initial, state) AS (VALUES ('e', 'K', 0, 's', 's'), ('e', 'K', 0, 'u', 'u'), ('s', 'K', 0, 'u', 'u'),
        ('a', 'K', 0, 'u', 'u'), ('u', 'K', 0, 'a', 'a'), ('e', 'R', 1, NULL, 'u'), ('s', 'R', 1, NULL, 'u'), ('a', 'R', 1, NULL, 'u'),
        ('u', 'R', 1, NULL, 'a'), ('e', 'D', 2, NULL, 'e'), ('s', 'D', 2, NULL, 's'), ('u', 'D', 2, NULL, 'u'), ('a', 'D', 2, NULL, 'a')),
v AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 'e' AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made, CAST(1 AS BIGINT) AS best
        FROM c UNION ALL
      SELECT conv_id, i, state, cost, audit, made, best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
        SELECT v.conv_id, f.i, step.state, v.cost + ins.cost + step.cost + CASE WHEN fault = 3 AND letter <> 'D' THEN 5 ELSE 0 END AS cost,
          v.audit || ins.label || letter AS audit, list_concat(list_concat(v.made, ins.added), CASE letter WHEN 'D' THEN []
            WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE step.state WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END) AS made
        FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i + 1 JOIN ins ON ins.was = v.state
          JOIN step ON step.upto = ins.upto AND (step.initial IS NULL OR step.initial = f.initial) AND (fault NOT IN (1, 2) OR letter = 'D')))
      WHERE best = 1),
z AS (SELECT v.conv_id, v.cost + ins.cost AS cost, v.audit || ins.label AS audit, list_concat(v.made, ins.added) AS made,
        row_number() OVER (PARTITION BY v.conv_id ORDER BY v.cost + ins.cost, v.audit || ins.label) AS best
      FROM v JOIN c ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i = c.n JOIN ins ON ins.was = v.state AND ins.upto IN ('e', 'a'))
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(z.cost, 0) AS BIGINT) AS cost, coalesce(z.audit, '') AS audit,
  sha256(coalesce(array_to_string(z.made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id AND z.best = 1
"""

# Slots come from digests; the last steps give each surplus slot to the shard with the fewest bytes, one after the other.
ORACLES["op12_sharding"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT text, CAST({_crc32("coalesce(text, '')")} AS BIGINT) AS crc FROM (SELECT DISTINCT text FROM documents), crc_table),
r AS (SELECT doc_id, CAST(octet_length(encode(coalesce(d.text, ''))) + 8 AS BIGINT) AS size, crc,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(crc AS VARCHAR)) AS digest
        FROM documents d JOIN t ON d.text IS NOT DISTINCT FROM t.text),
s AS (SELECT *, CAST('0x' || left(digest, 3) AS INTEGER) AS virtual_slot FROM r),
w AS (SELECT virtual_slot, greatest(count(*) * 200 / (SELECT count(*) FROM s), sum(size) * 200 / (SELECT sum(size) FROM s)) AS share
        FROM s GROUP BY virtual_slot),
p AS (SELECT s.*, CAST(CASE WHEN share > 1 THEN CAST('0x' || digest[4:11] AS BIGINT) % CAST(ceil(share) AS BIGINT) ELSE 0 END AS INTEGER) AS part
        FROM s JOIN w USING (virtual_slot)),
u AS (SELECT virtual_slot, part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, (virtual_slot + part) % 24 AS shard FROM p GROUP BY ALL),
k AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual_slot, part) > (SELECT sum(bytes) FROM u) / 24 AS released FROM u),
i AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, virtual_slot, part) AS i FROM k WHERE released),
h AS (SELECT list(coalesce(b, 0) ORDER BY x.shard) AS loads FROM (SELECT unnest(range(24)) AS shard) x
        LEFT JOIN (SELECT shard, CAST(sum(bytes) AS BIGINT) AS b FROM k WHERE NOT released GROUP BY shard) y USING (shard)),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(loads AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS best FROM h UNION ALL
      SELECT i, list_transform(loads, lambda v, j: CASE WHEN j = best THEN v + bytes ELSE v END), best FROM (
        SELECT i.i, g.loads, i.bytes, list_position(g.loads, list_min(g.loads)) AS best FROM g JOIN i ON i.i = g.i + 1)),
m AS (SELECT k.virtual_slot, k.part, k.n, CAST(CASE WHEN k.released THEN g.best - 1 ELSE k.shard END AS INTEGER) AS shard FROM k
        LEFT JOIN i ON i.virtual_slot = k.virtual_slot AND i.part = k.part LEFT JOIN g ON g.i = i.i)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, part, digest) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, virtual_slot
FROM p JOIN m USING (virtual_slot, part)
"""

ORACLES["op13_lexical_search"] = r"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM a),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM c GROUP BY ALL),
t AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM a WHERE len(ts) > 0),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM p, t GROUP BY term, docs),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN p USING (term), t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
