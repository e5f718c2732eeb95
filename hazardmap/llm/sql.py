"""SQL of the queries of this folder that SQL can express, over the documents and embeddings tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\v\f\r]+'), lambda x: x <> '')"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""

_SOFT = {
    "symbols": "n_symbols * 10 > n_words * {}",
    "dup_lines": "n_dup_lines * 10 > n_lines * 3 * {}",
    "word_length": "(word_chars > n_words * 15 * {0} OR word_chars * {0} < n_words * 2)",
    "shouting": "n_upper * 10 > n_letters * {1}",
}


def _soft(scale: int) -> dict[str, str]:
    return {k: v.format(scale, 6 if scale == 1 else 9) for k, v in _SOFT.items()}


_RULES = {"base": "base_failed", **_soft(1)}
_STRICT = " OR ".join(f"({v} AND rate_{k} >= 0.25)" for k, v in _soft(1).items())
_HARD = " OR ".join(f"({v})" for v in _soft(2).values())

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
t AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN t ON w.doc_id = t.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS n, {", ".join(f"sum(CASE WHEN {v} THEN 1 ELSE 0 END)::DOUBLE AS f_{k}" for k, v in _RULES.items())} FROM b GROUP BY source),
q AS (SELECT {", ".join(f"sum(f_{k}) / sum(n) AS m_{k}, coalesce(var_samp(f_{k} / n), 0) AS v_{k}" for k in _RULES)} FROM h),
o AS (SELECT host, n, {", ".join(f"f_{k}, m_{k}, CASE WHEN v_{k} > 0 AND m_{k} > 0 AND m_{k} < 1 THEN greatest(1.0, least(10000.0, m_{k} * (1 - m_{k}) / v_{k} - 1)) ELSE 100.0 END AS a_{k}" for k in _RULES)} FROM h, q),
e AS (SELECT host, {", ".join(f"(f_{k} + m_{k} * a_{k}) / (n + a_{k}) AS rate_{k}" for k in _RULES)} FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate_base < 0.8 AND NOT ({_STRICT} OR {_HARD}) AS kept
FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.host
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN doc_id <> keeper THEN 1 END) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN keeper IS NULL OR keeper = doc_id THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k GROUP BY doc_id
"""


def _clusters(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """The rounds as a chain of named steps."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT n - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS n FROM v) WHERE n <= {k})",
    ]
    for r in range(rounds + 1):
        steps += [
            f"d{r} AS (SELECT vec_id, v.v, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.v[i] - c{r}.v[i]) * (v.v[i] - c{r}.v[i])))::BIGINT AS d FROM v, c{r})",
            f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM d{r} GROUP BY vec_id)",
            f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(range(1, {dims + 1})) AS i, unnest(v) AS x FROM a{r}) GROUP BY c, i)",
            f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)",
        ]
    return f"""WITH {", ".join(steps[:-3])}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.m.c = c{rounds}.c
"""


CLUSTERS = _clusters()

NEGATIVES = """
WITH e AS MATERIALIZED (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
