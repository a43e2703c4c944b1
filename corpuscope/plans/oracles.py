"""The registered queries as SQL for a second engine, written from their definitions."""

from __future__ import annotations

from collections.abc import Iterable

from corpuscope.functions.text import PUNCTUATION, WHITESPACE
from corpuscope.operators.domain import UNKNOWN
from corpuscope.plans import fixture as X

WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"

PUNCT_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PUNCTUATION) + "]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(words: Iterable[str]) -> str:
    return ", ".join(map(lit, words))


def values(rows: Iterable[tuple]) -> str:
    def one(v) -> str:
        return str(v) if isinstance(v, int) else lit(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def lines(e: str) -> str:
    unified = f"replace(replace({e}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    stripped = f"list_transform(string_split({unified}, chr(10)), lambda l: {strip('l')})"
    return f"list_filter({stripped}, lambda l: l <> '')"


def tokens(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '{WS_CLASS}+'), lambda t: t <> '')"


def keep(e: str, pattern: str) -> str:
    return f"list_filter({e}, lambda t: regexp_matches(t, '{pattern}'))"


def script_tokens(e: str, profile) -> str:
    cls = profile.primary_class
    cond = f"length(t) >= {profile.min_token_length} AND regexp_matches(t, '{cls}')"
    return f"list_filter({tokens(e)}, lambda t: {cond})"


def norm_tokens(e: str) -> str:
    return tokens(f"regexp_replace({e}, '({PUNCT_CLASS})', ' \\1 ', 'g')")


def joined(e: str) -> str:
    return f"array_to_string({e}, '|')"


def matches(e: str, pattern: str) -> str:
    return f"len(regexp_extract_all({e}, '{pattern}'))"


def occurrences(e: str, w: str) -> str:
    return f"((length({e}) - length(replace({e}, {w}, ''))) // length({w}))"


ORACLES: dict[str, str] = {}

# -- per-document expressions ---------------------------------------------------------------

ORACLES["doc_text"] = f"""
SELECT doc_id, array_to_string({lines('text')}, ' ') AS text FROM documents"""

ORACLES["doc_hash"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"


def stats(profile) -> str:
    return f"""
SELECT doc_id, lang, text, CAST(len({lines('text')}) AS INTEGER) AS sentence_count,
       CAST(length(text) AS INTEGER) AS char_count, sha256(text) AS sha256,
       CAST(len(k) AS INTEGER) AS token_count,
       CAST(len({keep('k', profile.primary_class)}) AS INTEGER) AS primary_token_count,
       CAST(len({keep('k', profile.secondary)}) AS INTEGER) AS latin_token_count,
       CASE WHEN len(k) > 0 THEN len({keep('k', profile.secondary)}) / len(k) ELSE 0.0 END AS mix_rate
FROM (SELECT *, {tokens('text')} AS k FROM documents)"""


ORACLES["doc_stats"] = f"""
SELECT doc_id, sentence_count, char_count, sha256, token_count, primary_token_count,
       latin_token_count, round(mix_rate, 6) AS mix_rate FROM ({stats(X.ACCENTED)})"""

ORACLES["script_tokens"] = f"""
SELECT doc_id, {joined(script_tokens('text', X.ACCENTED))} AS tokens FROM documents"""

TOKEN_ROWS = f"SELECT lang, unnest({script_tokens('text', X.PROFILE)}) AS token FROM documents"
ORACLES["token_rows"] = TOKEN_ROWS

SHINGLED = f"""
SELECT doc_id, lang, sha256(text) AS sha256,
       CASE WHEN len(k) >= {X.SHINGLE} THEN array_to_string(k[1:{X.SHINGLE}], ' ') END AS shingle
FROM (SELECT *, {script_tokens('text', X.PROFILE)} AS k FROM documents)"""
ORACLES["leading_shingle"] = f"SELECT doc_id, shingle FROM ({SHINGLED})"

_collapsed = f"regexp_replace(text, '{WS_CLASS}+', ' ', 'g')"
_spaced = f"regexp_replace({_collapsed}, '({PUNCT_CLASS})', ' \\1 ', 'g')"
ORACLES["normalize_text"] = f"SELECT doc_id, {strip(_spaced)} AS text FROM documents"

ORACLES["norm_tokens"] = f"""
SELECT doc_id, {joined(norm_tokens('text'))} AS tokens FROM documents"""

ORACLES["match_count"] = f"""
SELECT doc_id, CAST({matches('text', X.COUNTED_PATTERN)} AS BIGINT) AS matches FROM documents"""

ORACLES["literal_count"] = "SELECT doc_id, " + ", ".join(
    f"CAST({occurrences('text', lit(w))} AS BIGINT) AS n_{w}" for w in X.COUNTED_WORDS
) + " FROM documents"

# -- domain inference -----------------------------------------------------------------------


def lexicon(model) -> str:
    per_seed = ((d, w) for d, ws in model.seeds.items() for w in ws)
    sums = ", ".join(
        f"CAST(sum(CASE WHEN s.d = '{d}' THEN {occurrences('text', 's.w')} END) AS INTEGER) "
        f"AS lex_{d}"
        for d in model.domains
    )
    return f"""
SELECT doc_id, {sums} FROM documents CROSS JOIN {values(per_seed)} AS s(d, w) GROUP BY doc_id"""


ORACLES["lexicon_score"] = lexicon(X.MODEL)
ORACLES["lexicon_score_wide"] = lexicon(X.WIDE_MODEL)

_umlaut = " OR ".join(f"contains(text, {lit(p)})" for p in X.UMLAUTS)
RULES = f"""
SELECT doc_id,
       CAST((CASE WHEN regexp_matches(text, '{X.HEX_RUN}') THEN 3 ELSE 0 END)
          + (CASE WHEN {matches('text', X.THE)} >= {X.MANY_THE} THEN 4 ELSE 0 END)
          + (CASE WHEN token_count > 0 AND mix_rate > {X.HIGH_MIX} THEN 2 ELSE 0 END)
          AS INTEGER) AS rule_en,
       CAST(CASE WHEN regexp_matches(text, '{X.SHOUT}') THEN 2 ELSE 0 END AS INTEGER) AS rule_fr,
       CAST(CASE WHEN {_umlaut} THEN 5 ELSE 0 END AS INTEGER) AS rule_de,
       CAST(CASE WHEN token_count < {X.SHORT_TEXT} THEN 1 ELSE 0 END AS INTEGER) AS rule_es
FROM ({stats(X.PROFILE)})"""
ORACLES["rule_scores"] = RULES

_winner = " ".join(f"WHEN s_{d} = best THEN '{d}'" for d in X.MODEL.domains)
INFERRED = f"""
SELECT doc_id,
       CASE WHEN text = '' OR best = 0 THEN '{UNKNOWN}'
            WHEN best / total < {X.MODEL.min_confidence} THEN '{UNKNOWN}'
            ELSE CASE {_winner} END END AS predicted_domain,
       CASE WHEN text <> '' AND total > 0 THEN best / total END AS confidence
FROM (SELECT *, greatest({', '.join(f's_{d}' for d in X.MODEL.domains)}) AS best,
             {' + '.join(f's_{d}' for d in X.MODEL.domains)} AS total
      FROM (SELECT d.doc_id, d.text, {', '.join(f'lex_{d} + rule_{d} AS s_{d}' for d in X.MODEL.domains)}
            FROM documents d JOIN ({lexicon(X.MODEL)}) USING (doc_id)
                             JOIN ({RULES}) USING (doc_id)))"""
ORACLES["infer_domain"] = f"""
SELECT doc_id, predicted_domain, round(confidence, 6) AS confidence FROM ({INFERRED})"""

ORACLES["domain_distribution"] = f"""
SELECT predicted_domain, count(*) AS document_count FROM ({INFERRED}) GROUP BY predicted_domain"""

LABELLED = f"SELECT * FROM ({stats(X.ACCENTED)}) JOIN ({INFERRED}) USING (doc_id)"
ORACLES["domain_stats"] = f"""
SELECT predicted_domain, count(*) AS document_count, round(avg(token_count), 6) AS avg_tokens,
       round(stddev_samp(token_count), 6) AS std_tokens,
       quantile_disc(token_count, 0.5) AS median_tokens,
       round(avg(sentence_count), 6) AS avg_sentences,
       round(avg(char_count), 6) AS avg_characters, round(avg(mix_rate), 6) AS avg_mix_rate,
       CAST(sum(token_count) AS BIGINT) AS total_tokens
FROM ({LABELLED}) GROUP BY predicted_domain"""

ORACLES["corpus_totals"] = f"""
SELECT count(*) AS documents, count(DISTINCT predicted_domain) AS domains,
       CAST(sum(token_count) AS BIGINT) AS tokens, CAST(sum(char_count) AS BIGINT) AS characters
FROM ({LABELLED})"""

ORACLES["keyed_sample_docs"] = f"""
SELECT doc_id, lang FROM documents
WHERE CAST('0x' || substr(md5('{X.SAMPLE_SALT}' || doc_id), 1, 8) AS UBIGINT) / 4294967296.0
      < {X.SAMPLE_FRACTION}"""

ORACLES["keyed_sample_texts"] = f"""
SELECT doc_id, text FROM documents
WHERE CAST('0x' || substr(md5('{X.SAMPLE_SALT}' || doc_id), 1, 8) AS UBIGINT) / 4294967296.0
      < {X.ODD_FRACTION}"""

# -- vocabulary -----------------------------------------------------------------------------

COUNTS = f"SELECT lang, token, count(*) AS count FROM ({TOKEN_ROWS}) GROUP BY lang, token"
ORACLES["token_frequency"] = COUNTS

ORACLES["ttr"] = f"""
SELECT lang, count(*) AS total_tokens, count(DISTINCT token) AS unique_tokens,
       round(count(DISTINCT token) / count(*), 6) AS ttr FROM ({TOKEN_ROWS}) GROUP BY lang"""

ORACLES["ttr_sketched"] = f"""
SELECT lang, count(*) AS total_tokens, true AS within_bound FROM ({TOKEN_ROWS}) GROUP BY lang"""

ORACLES["top_tokens"] = f"""
SELECT * FROM (SELECT lang, token, count, CAST(row_number() OVER
       (PARTITION BY lang ORDER BY count DESC, token) AS INTEGER) AS rank FROM ({COUNTS}))
WHERE rank <= 100"""

# -- duplicates -----------------------------------------------------------------------------

ORACLES["exact_dedup"] = """
SELECT doc_id, lang, sha256 FROM (
  SELECT doc_id, lang, sha256(text) AS sha256,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1"""

ORACLES["exact_dup_summary"] = """
SELECT count(*) AS documents_before, count(DISTINCT text) AS documents_after,
       count(*) - count(DISTINCT text) AS exact_duplicates,
       round((count(*) - count(DISTINCT text)) / count(*), 6) AS exact_duplicate_rate
FROM documents"""

SURVIVORS = f"""
SELECT doc_id, lang, shingle FROM (
  SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id) AS r FROM ({SHINGLED}))
WHERE r = 1 AND shingle IS NOT NULL"""
CLUSTERS = f"""
SELECT shingle, CAST(count(*) AS BIGINT) AS cluster_size, CAST(count(lang) AS BIGINT) AS doc_count
FROM ({SURVIVORS}) GROUP BY shingle HAVING count(*) > 1"""
ORACLES["near_dup_clusters"] = CLUSTERS

ORACLES["near_dup_summary"] = f"""
SELECT e AS eligible_documents, c AS near_duplicate_clusters, s - c AS near_duplicate_documents,
       round((s - c) / e, 6) AS near_duplicate_rate
FROM (SELECT (SELECT count(*) FROM ({SURVIVORS})) AS e, count(*) AS c,
             CAST(sum(cluster_size) AS BIGINT) AS s FROM ({CLUSTERS}))"""

ORACLES["dup_report"] = f"""
SELECT * FROM (SELECT count(*) AS documents_before, count(DISTINCT text) AS documents_after FROM documents),
              ({ORACLES["near_dup_summary"]})"""

MEMBERS = f"SELECT * FROM ({SURVIVORS}) SEMI JOIN ({CLUSTERS}) USING (shingle)"
ORACLES["near_dup_members"] = f"SELECT doc_id, lang, shingle FROM ({MEMBERS})"
ORACLES["near_dup_by_domain"] = f"""
SELECT lang, count(*) AS near_dup_doc_count FROM ({MEMBERS}) GROUP BY lang"""

ORACLES["top_dup_clusters"] = f"""
SELECT * FROM ({CLUSTERS}) ORDER BY cluster_size DESC, shingle LIMIT 50"""

ORACLES["dup_cluster_texts"] = f"""
SELECT * FROM ({CLUSTERS}) ORDER BY cluster_size DESC, sha256(shingle) LIMIT 3"""

# -- topics ---------------------------------------------------------------------------------

_content = (
    f"list_filter({script_tokens('text', X.PROFILE)}, lambda w: lower(w) NOT IN ({lits(X.STOPWORDS)}))"
)
ORACLES["stopword_filter"] = f"SELECT doc_id, {joined(_content)} AS tokens FROM documents"

ORACLES["vocab_df"] = f"""
SELECT term, count(DISTINCT doc_id) AS document_frequency, count(*) AS term_count
FROM (SELECT doc_id, unnest({_content}) AS term FROM documents)
GROUP BY term HAVING count(DISTINCT doc_id) >= 2"""

_VOCABULARY = f"""
SELECT term FROM (SELECT doc_id, unnest({_content}) AS term FROM documents)
GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY count(*) DESC, term LIMIT 1000"""

_DICTIONARY = f"""
SELECT term, row_number() OVER (ORDER BY term_count DESC, term) - 1 AS term_id, document_frequency, term_count
FROM ({ORACLES["vocab_df"]})"""
ORACLES["term_dictionary"] = _DICTIONARY

ORACLES["term_vectors"] = f"""
SELECT doc_id, term_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_content}) AS term FROM documents)
JOIN ({_DICTIONARY}) USING (term) GROUP BY doc_id, term_id, term"""

# What holds of any topics that were fitted; the weights themselves are drawn.
ORACLES["lda_topics"] = """
SELECT CAST(t.topic AS INTEGER) AS topic, CAST(r.rank AS INTEGER) AS rank, true AS orderly,
       true AS in_vocabulary
FROM range(3) t(topic), range(1, 16) r(rank)"""

ORACLES["fit_quality"] = f"""
SELECT count(*) AS vocabulary_tokens, true AS perplexity_is_loss_per_token,
       true AS likelihood_is_negative
FROM (SELECT unnest({_content}) AS term FROM documents) WHERE term IN ({_VOCABULARY})"""

ORACLES["stable_topics"] = ORACLES["lda_topics"].replace("range(3)", "range(20)")

ORACLES["stable_fit_quality"] = f"""
SELECT count(*) AS vocabulary_tokens, true AS perplexity_is_loss_per_token,
       true AS likelihood_is_negative, true AS same_elsewhere
FROM (SELECT unnest({_content}) AS term FROM documents)
WHERE term IN (SELECT term FROM ({ORACLES["vocab_df"]}) WHERE document_frequency >= 5
               ORDER BY term_count DESC, term LIMIT 50000)"""

# -- audits ---------------------------------------------------------------------------------

WORDS = f"""
SELECT doc_id, lang, CAST(len(k) AS BIGINT) AS size, unnest(k) AS t,
       CAST(unnest(range(len(k))) AS BIGINT) AS pos
FROM (SELECT doc_id, lang, {norm_tokens('text')} AS k FROM documents)"""


def grams(longest: int) -> str:
    """At every position, the next words as phrases of 1 to ``longest`` words."""
    ahead = ", ".join(
        f"lead(t, {n}) OVER (PARTITION BY doc_id ORDER BY pos) AS t{n}" for n in range(1, longest)
    )
    parts = []
    for n in range(1, longest + 1):
        phrase = " || ' ' || ".join(["t", *[f"t{i}" for i in range(1, n)]])
        parts.append(
            f"SELECT doc_id, lang, size, pos AS start, {n} AS n, {phrase} AS phrase FROM w "
            f"WHERE pos + {n} <= size"
        )
    words = f"SELECT *, {ahead} FROM words" if ahead else "SELECT * FROM words"
    return f"WITH w AS MATERIALIZED ({words}) " + " UNION ALL ".join(parts)


def hits(entries: Iterable[str]) -> str:
    rows = [(p, len(p.split(" "))) for p in entries]
    longest = max(n for _, n in rows)
    return (
        f"SELECT g.* FROM ({grams(longest)}) g "
        f"SEMI JOIN {values(rows)} AS e(phrase, n) USING (phrase, n)"
    )


ORACLES["phrase_hits"] = f"""
WITH words AS MATERIALIZED ({WORDS}) SELECT doc_id, start, n, phrase FROM ({hits(X.PHRASES)})"""


_openings = " UNION ".join(
    f"SELECT {n} AS n, array_to_string(k[1:{n}], ' ') AS phrase FROM "
    f"(SELECT {norm_tokens('text')} AS k FROM documents) WHERE len(k) >= {n}"
    for n in X.OPENINGS
)
ORACLES["phrase_table_hits"] = f"""
WITH words AS MATERIALIZED ({WORDS}), e AS MATERIALIZED ({_openings})
SELECT doc_id, start, n, phrase FROM (SELECT g.* FROM ({grams(max(X.OPENINGS))}) g SEMI JOIN e USING (phrase, n))"""


def one_word_scores(lex) -> str:
    """With one-word lists every marker inside the window counts, the one on the occupation too."""
    return f"""
WITH words AS MATERIALIZED ({WORDS}),
occ AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM words
        QUALIFY t IN ({lits(lex.occupations)})),
pts AS (
  SELECT o.doc_id, o.lang, o.t AS occupation, 0 AS m, 0 AS f, o.before FROM occ o
  UNION ALL
  SELECT o.doc_id, o.lang, o.t, CAST(w.t IN ({lits(lex.male)}) AS INTEGER),
         CAST(w.t IN ({lits(lex.female)}) AS INTEGER), NULL
  FROM occ o JOIN words w ON o.doc_id = w.doc_id AND w.pos BETWEEN o.pos - 10 AND o.pos + 10)
SELECT doc_id, lang, occupation,
       CAST(sum(m) + count(*) FILTER (before IN ({lits(lex.male_prefixes)})) AS INTEGER) AS male,
       CAST(sum(f) + count(*) FILTER (before IN ({lits(lex.female_prefixes)})) AS INTEGER) AS female
FROM pts GROUP BY doc_id, lang, occupation"""


SCORES = f"""
SELECT *, ln((male + 0.5) / (female + 0.5)) AS score FROM ({one_word_scores(X.WORD_LEXICON)})
WHERE male + female > 0"""
_score_columns = "doc_id, lang, occupation, male, female, round(score, 6) AS score"
ORACLES["gender_scores"] = f"SELECT {_score_columns} FROM ({SCORES})"


def phrase_scores(lex) -> str:
    """Greedy scans as recursion: from a free position the longest marker that fits is taken, and
    the scan goes on behind it; a position without one is stepped over."""
    sides = (("m", lex.male), ("f", lex.female))
    marker_rows = [(s, p, len(p.split(" "))) for s, ps in sides for p in ps]
    deepest = max(n for _, _, n in marker_rows)
    return f"""
WITH RECURSIVE words AS MATERIALIZED ({WORDS}),
occ AS (SELECT h.*, w.before, greatest(h.start - 10, 0) AS lo,
               least(h.start + h.n + 10, h.size) AS hi
        FROM ({hits(lex.occupations)}) h
        JOIN (SELECT doc_id, pos, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS before
              FROM words) w ON w.doc_id = h.doc_id AND w.pos = h.start),
marks AS (SELECT g.doc_id, g.start AS pos, g.n, e.side
          FROM ({grams(deepest)}) g JOIN {values(marker_rows)} AS e(side, phrase, n) USING (phrase, n)),
near AS (SELECT o.doc_id, o.start, o.n AS len, o.phrase, m.side, m.pos, m.n
         FROM occ o JOIN marks m ON o.doc_id = m.doc_id AND m.pos >= o.lo AND m.pos + m.n <= o.hi),
longest AS (SELECT doc_id, start, len, phrase, side, pos, max(n) AS n FROM near
            GROUP BY ALL),
taken AS (
  SELECT * FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, start, len, phrase, side) AS head
                 FROM longest) WHERE pos = head
  UNION ALL
  SELECT l.*, l.pos FROM (
    SELECT t.doc_id, t.start, t.len, t.phrase, t.side, min(l.pos) AS pos
    FROM taken t JOIN longest l ON l.doc_id = t.doc_id AND l.start = t.start AND l.len = t.len
         AND l.phrase = t.phrase AND l.side = t.side AND l.pos >= t.pos + t.n
    GROUP BY t.doc_id, t.start, t.len, t.phrase, t.side) nx
  JOIN longest l USING (doc_id, start, len, phrase, side, pos)),
pts AS (
  SELECT doc_id, phrase, CASE WHEN before IN ({lits(lex.female_prefixes)}) THEN 'f'
                              WHEN before IN ({lits(lex.male_prefixes)}) THEN 'm' END AS side, 1 AS p
  FROM occ WHERE before IN ({lits(lex.female_prefixes + lex.male_prefixes)}) AND start > 0
  UNION ALL
  SELECT doc_id, phrase, side, 1 FROM taken
  WHERE (pos = start AND n = len) OR NOT (pos < start + len AND pos + n > start))
SELECT doc_id, d.lang, phrase AS occupation,
       CAST(coalesce(sum(p) FILTER (side = 'm'), 0) AS INTEGER) AS male,
       CAST(coalesce(sum(p) FILTER (side = 'f'), 0) AS INTEGER) AS female
FROM pts JOIN documents d USING (doc_id)
WHERE NOT contains(phrase, ' ') OR contains(d.text, phrase)
GROUP BY doc_id, d.lang, phrase"""


ORACLES["gender_scores_phrases"] = f"""
SELECT doc_id, lang, occupation, male, female,
       round(ln((male + 0.5) / (female + 0.5)), 6) AS score
FROM ({phrase_scores(X.PHRASE_LEXICON)}) WHERE male + female > 0"""

_direction = """CASE WHEN a IS NULL THEN 'insufficient data' WHEN a > 0 THEN 'male-leaning'
     ELSE 'female-leaning' END"""
BIAS = f"""
WITH s AS (SELECT *, CAST(score AS DECIMAL(18,12)) AS x FROM ({SCORES})),
g AS (
  SELECT occupation, lang AS domain, CAST(sum(x) AS DOUBLE) / count(*) AS a, count(*) AS doc_count
  FROM s GROUP BY occupation, lang
  UNION ALL
  SELECT o.w, 'ALL', CAST(sum(x) AS DOUBLE) / nullif(count(x), 0), count(x)
  FROM {values((o,) for o in X.WORD_LEXICON.occupations)} AS o(w) LEFT JOIN s ON s.occupation = o.w
  GROUP BY o.w)
SELECT occupation, domain, round(a, 4) AS avg_bias_score, doc_count, {_direction} AS direction
FROM g"""
ORACLES["gender_bias"] = BIAS

_evaluated = f"SELECT * FROM ({BIAS}) WHERE domain = 'ALL' AND avg_bias_score IS NOT NULL"
ORACLES["gender_share"] = f"""
SELECT count(*) AS evaluated, count(*) FILTER (direction = 'male-leaning') AS male_leaning,
       round(count(*) FILTER (direction = 'male-leaning') / count(*), 6) AS male_leaning_share
FROM ({_evaluated})"""


def _side(name: str, way: str) -> str:
    return f"""
SELECT '{name}' AS side, CAST(row_number() OVER (ORDER BY avg_bias_score {way}, occupation)
       AS INTEGER) AS rank, occupation, avg_bias_score, doc_count FROM ({_evaluated})
QUALIFY rank <= 2"""


ORACLES["gender_extremes"] = f"""
SELECT * FROM ({_side('male', 'DESC')}) UNION ALL SELECT * FROM ({_side('female', 'ASC')})"""

_per_place = " UNION ALL ".join(
    f"SELECT '{p}' AS place, lang, {matches('text', '|'.join(s))} AS m FROM documents"
    for p, s in X.PLACES.items()
)
MENTIONS = f"""
SELECT place, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS domain,
       CAST(sum(m) AS BIGINT) AS total_mentions
FROM ({_per_place}) GROUP BY GROUPING SETS ((place, lang), (place))"""
ORACLES["geo_mentions"] = MENTIONS

ORACLES["geo_share"] = f"""
SELECT place, total_mentions, round(total_mentions / sum(total_mentions) OVER () * 100, 6) AS share_pct
FROM ({MENTIONS}) WHERE domain = 'ALL'"""

# -- sources --------------------------------------------------------------------------------

ORACLES["parsed_documents"] = f"""
SELECT sha256 AS doc_id, text, sentence_count, token_count, char_count, primary_token_count,
       latin_token_count, round_even(mix_rate, 4) AS mix_rate, sha256, '{UNKNOWN}' AS predicted_domain
FROM (SELECT s.* EXCLUDE (sentence_count), n AS sentence_count FROM (
        SELECT * FROM ({stats(X.ACCENTED).replace(
            'FROM documents',
            f"FROM (SELECT doc_id, lang, array_to_string({lines('text')}, ' ') AS text, "
            f"CAST(len({lines('text')}) AS INTEGER) AS n FROM documents)",
        )}) JOIN (SELECT doc_id, CAST(len({lines('text')}) AS INTEGER) AS n FROM documents)
        USING (doc_id)) s)
WHERE text <> ''"""

ORACLES["parsed_documents_spaced"] = ORACLES["parsed_documents"]

ORACLES["row_keys"] = f"""
SELECT count(*) AS documents, count(*) AS keys, true AS gapless
FROM (SELECT array_to_string({lines('text')}, ' ') AS text FROM documents) WHERE text <> ''"""

for _sink in ("parquet", "csv", "json_lines"):
    ORACLES[f"sink_{_sink}"] = "SELECT doc_id, lang, nullif(lang, 'fr') AS not_fr FROM documents"
ORACLES["sink_json_report"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"

ORACLES["topics_reloaded"] = """
SELECT CAST(t.topic AS INTEGER) AS topic, CAST(r.rank AS INTEGER) AS rank, true AS same
FROM range(3) t(topic), range(1, 16) r(rank)"""

ORACLES["rule_group"] = f"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '{X.GROUP_PATTERN}', 1), lambda x: x <> '')) >= 3 AS fires
FROM documents"""

ORACLES["lexicon_rows"] = f"""
SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY first_at) - 1 AS INTEGER) AS ord, entry,
       CAST(len({tokens('entry')}) AS INTEGER) AS n_words
FROM (SELECT list, entry, min(line_at) AS first_at
      FROM (SELECT doc_id AS list, unnest(l) AS entry, unnest(range(len(l))) AS line_at
            FROM (SELECT doc_id, {lines('text')} AS l FROM documents))
      GROUP BY list, entry)"""

ORACLES["largest_label_texts"] = """
SELECT doc_id, lang, text FROM documents WHERE lang = (
  SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang NULLS FIRST LIMIT 1)"""

ORACLES["sink_csv_texts"] = ORACLES["sink_json_texts"] = """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN ''
       ELSE '"a", ' || text || chr(10) || chr(92) || '"b" ' END AS cell FROM documents"""
