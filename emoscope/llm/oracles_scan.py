"""DuckDB SQL of the license scan, the divergence audit and the hard negatives."""

from __future__ import annotations

from emoscope.llm.license_scan import NOTICES, PHRASES

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATES = ",\n  ".join(f"({t}, '{x.label}', {str(t < len(PHRASES)).lower()}, '{x.text}')"
                          for t, x in enumerate([*PHRASES, *NOTICES]))

OP11 = rf"""
WITH templates(t, label, phrase, words) AS (
  SELECT t, label, phrase, string_split(x, ' ') FROM (VALUES
  {_TEMPLATES}) v(t, label, phrase, x)
), tg AS (
  SELECT t, label, phrase, len(words) AS size, j, words[j + 1] || ' ' || words[j + 2] || ' ' || words[j + 3] AS g
  FROM (SELECT *, unnest(range(len(words) - 2)) AS j FROM templates)
), d AS (
  SELECT doc_id, list_filter(string_split_regex({_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), hits AS (
  SELECT DISTINCT doc_id, t, label, phrase, size, i - j AS diag, j FROM (
    SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
    FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d)) JOIN tg USING (g)
), diags AS (
  SELECT doc_id, t, label, phrase, size, diag, count(*) AS votes, min(j) AS j0, max(j) AS j1 FROM hits GROUP BY ALL
), places AS (
  SELECT doc_id, label, diag AS start FROM diags WHERE phrase AND votes = size - 2
), steps AS (
  SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, t ORDER BY diag) <= 3 THEN 0 ELSE 1 END AS fresh
  FROM diags WHERE NOT phrase
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diag) AS span FROM steps
), covers AS (
  SELECT doc_id, t, span, count(DISTINCT j + o) AS covered
  FROM hits JOIN grouped USING (doc_id, t, diag), (VALUES (0), (1), (2)) v(o) GROUP BY ALL
), spans AS (
  SELECT doc_id, t, label, covered, covered / size::DOUBLE AS coverage, first_, last_ FROM covers JOIN (
    SELECT doc_id, t, span, label, size, min(diag + j0) AS first_, max(diag + j1 + 3) AS last_ FROM grouped GROUP BY ALL
  ) USING (doc_id, t, span) WHERE covered / size::DOUBLE >= 0.75
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY first_, last_, t) AS island FROM (
    SELECT *, CASE WHEN first_ < max(last_) OVER (PARTITION BY doc_id ORDER BY first_, last_, t
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans)
), best AS (
  SELECT * FROM islands QUALIFY rank() OVER (PARTITION BY doc_id, island ORDER BY covered DESC, coverage DESC) = 1
), found AS (
  SELECT doc_id, label, coverage FROM best UNION ALL SELECT doc_id, label, 1.0::DOUBLE FROM places
), labels_ AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY doc_id
), base AS (
  SELECT doc_id, count(*) AS n, min(start) AS a, max(start) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word,
  base.b::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(labels_.labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels_ USING (doc_id)
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.e, r.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.vec_id, s.score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
) WHERE rank <= 3
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_AZ} AS t FROM documents
), o AS (
  SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)
), l AS (
  SELECT lang, sum(n)::BIGINT AS total FROM c GROUP BY lang
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT lang, term, 1 + 1000000000 * (sum(n)::BIGINT + 1) // (any_value(l.total) + any_value(v.v)) AS q
  FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

SQL = {"op12_source_divergence": OP12, "op13_hard_negatives": OP13, "op11_license_scan": OP11}
