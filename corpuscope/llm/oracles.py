"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_QUALITY = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), counts AS (
  SELECT r, doc_id, source, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS wins
  FROM t
), wins AS (
  SELECT r, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM counts
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, i AS p FROM twice UNION ALL SELECT r, i + 1 FROM twice UNION ALL SELECT r, i + 2 FROM twice) GROUP BY r
), rules AS (
  SELECT doc_id, source, n_words, word_chars, n_symbols,
         CASE WHEN len(lines) > 0 THEN len(lines) - len(list_distinct(lines)) ELSE 0 END AS n_dup_lines,
         len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM counts LEFT JOIN covered c USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
           OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS more
  FROM rules
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR more) AS k
  FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
  SELECT count(*) AS hosts, sum(n) AS docs, sum(k) AS failed, sum(n * (k / n) * (k / n)) AS squares FROM hosts
), prior AS (
  SELECT least(greatest(failed / docs, 1e-6), 1 - 1e-6) AS m,
         squares / docs - (failed / docs) ** 2 AS spread, hosts / docs AS per FROM moments
), weight AS (
  SELECT m, CASE WHEN spread - m * (1 - m) * per > 0
    THEN least(greatest(m * (1 - m) / (spread - m * (1 - m) * per) - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM prior
), refused AS (
  SELECT source FROM hosts, weight WHERE (k + m * s) / (n + s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM refused)) AS kept
FROM judged
"""

# Twenty bits of the digest at a time are four base32 digits.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> {shift}) % 32 + 1, 1)"
_BASE32 = " || ".join(_DIGIT.format(shift=n) for n in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), parts AS (
  SELECT page_id, x, i, ('0x' || substr(x, 5 * i + 1, 5))::BIGINT AS v FROM p, range(8) t(i)
), digests AS (
  SELECT page_id, x, string_agg({_BASE32}, '' ORDER BY i) AS payload_digest FROM parts GROUP BY page_id, x
), first AS (
  SELECT x, min(page_id) AS first_id FROM p GROUP BY x
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(first_id, page_id) AS refers_to
FROM p JOIN digests USING (page_id, x) JOIN first USING (x)
"""

_NEAR = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a
), roots AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN roots USING (doc_id)
"""

# The remainders of CRC-32 for every byte, then the checksum of a number's digits.
_TRIE = r"""
WITH remainders AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
         substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'d': digest, 'w': words} ORDER BY turn NULLS FIRST, role, digest, words) AS t FROM turns GROUP BY conv_id
), heads AS (
  SELECT o.conv_id, o.t, coalesce(b.t, []) AS b,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(o.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda a, x: xor(a >> 8, r.t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM own o CROSS JOIN remainders r LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), rebuilt AS (
  SELECT conv_id, list_concat(b[1:h], t[h + 1:]) AS t FROM heads
), prefixes AS (
  SELECT conv_id, depth, array_to_string(list_transform(t[1:depth], lambda x: x.d), '') AS key,
         array_to_string(list_transform(t[1:depth - 1], lambda x: x.d), '') AS parent,
         CASE WHEN depth > 0 THEN t[depth].w ELSE 0 END AS words, len(t) AS size
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT key, min(depth) AS depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends
  FROM prefixes GROUP BY key
), children AS (
  SELECT parent AS key, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY parent
), sums AS (
  SELECT p.key, count(*) FILTER (WHERE c.k IS NULL) AS leaves, sum((n.n - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN children c ON c.key = n.key
  JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.k, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN children c ON c.key = n.key
LEFT JOIN nodes up ON n.depth > 0 AND up.key = n.parent
"""

_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, k.n AS n_lang, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM full_counts GROUP BY ALL
), prices AS (
  SELECT f.lang, f.source, f.term, f.n, 1 + 1000000000::HUGEINT * (f.n + 5) // (t.total + 5 * l.v) AS p,
         1 + 1000000000::HUGEINT * (f.n_lang + 5) // (l.n + 5 * l.v) AS q
  FROM full_counts f JOIN totals t USING (lang, source) JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN prices x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN prices y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM prices WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": _QUALITY,
    "op3_warc_captures": _WARC,
    "op8_minhash_near_duplicates": _NEAR,
    "op11_source_divergence": _DIVERGENCE,
    "op12_conversation_trie": _TRIE,
}
