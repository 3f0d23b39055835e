"""DuckDB SQL for the queries that SQL can express, written on its own."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), grams AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY k
), lines AS (
  SELECT k, count(*) AS n, count(*) - count(DISTINCT x) AS dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower_,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (k) LEFT JOIN covered USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR upper_ > lower_
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_repeat_words > 3 * n_words) AS kept
FROM f
"""

_RATES = ["40"] * 4 + ["10"] * 4 + ["08"] * 4 + ["04"] * 4
_PART_COLUMNS = ",\n    ".join(
    f"coalesce(substr(md5(string_agg(term, ' ' ORDER BY term) FILTER (WHERE known AND substr(md5(term), {2 * r + 1}, 2) < '{top}')), 1, 12), '') AS p{r}"
    for r, top in enumerate(_RATES))
_JOINED = " || '-' || ".join(f"p{r}" for r in range(16))

OP2 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
    coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id,
    coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS next_text
  FROM documents WINDOW o AS (ORDER BY doc_id DESC)
), e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM d
), t AS (
  SELECT doc_id, kind, unnest(list_distinct({_WORDS.format("lower(x)")})) AS term
  FROM (SELECT doc_id, 'o' AS kind, text AS x FROM e UNION ALL SELECT doc_id, 'e', edited FROM e)
), lexicon AS (
  SELECT term FROM t WHERE kind = 'o' GROUP BY term
  HAVING count(*) BETWEEN 0.01 * (SELECT count(*) FROM documents) AND 0.3 * (SELECT count(*) FROM documents)
), marked AS (
  SELECT doc_id, kind, t.term, lexicon.term IS NOT NULL AS known FROM t LEFT JOIN lexicon USING (term)
), parts AS (
  SELECT doc_id, kind, {_PART_COLUMNS},
    'x' || md5(string_agg(term, ' ' ORDER BY term)) AS whole
  FROM marked GROUP BY doc_id, kind
), prints AS (
  SELECT doc_id, kind, CASE WHEN replace({_JOINED}, '-', '') = '' THEN whole ELSE {_JOINED} END AS f FROM parts
), wide AS (
  SELECT e.doc_id, e.n_chars, e.edited, coalesce(o.f, 'x' || md5('')) AS a, coalesce(b.f, 'x' || md5('')) AS b,
    coalesce(n.f, 'x' || md5('')) AS n
  FROM e LEFT JOIN prints o ON o.doc_id = e.doc_id AND o.kind = 'o'
    LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 'e'
    LEFT JOIN prints n ON n.doc_id = e.next_id AND n.kind = 'o'
), likes AS (
  SELECT *, list_filter(list_zip(string_split(a, '-'), string_split(b, '-')), lambda x: coalesce(x[1], '') <> '' OR coalesce(x[2], '') <> '') AS ab,
    list_filter(list_zip(string_split(a, '-'), string_split(n, '-')), lambda x: coalesce(x[1], '') <> '' OR coalesce(x[2], '') <> '') AS an
  FROM wide
)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_filter(ab, lambda x: x[1] IS NOT DISTINCT FROM x[2]))::DOUBLE / greatest(len(ab), 1) END AS near_edited,
  CASE WHEN a = n THEN 1.0::DOUBLE ELSE len(list_filter(an, lambda x: x[1] IS NOT DISTINCT FROM x[2]))::DOUBLE / greatest(len(an), 1) END AS near_next
FROM likes
"""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines,
    list_transform(string_split({_AZ}, chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS keys
  FROM documents
), hot AS (
  SELECT key FROM (SELECT doc_id, unnest(keys) AS key FROM d) WHERE length(key) >= 1
  GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(keys) AS key, unnest(range(len(lines))) AS pos FROM d
), m AS (
  SELECT l.*, hot.key IS NOT NULL AS gone FROM l LEFT JOIN hot ON l.key = hot.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(_AZ)} AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), c AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

SQL = {
    "op1_quality_rules": OP1,
    "op2_document_fingerprints": OP2,
    "op3_line_dedup": OP3,
    "op7_minhash_near_dedup": OP7,
}
