"""DuckDB SQL for the rows of those corpus queries that SQL can express."""

from __future__ import annotations

#: Documents with their words (runs of what is no ASCII white space).
_WORDS = r"""
words AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
)"""

OP7 = rf"""
WITH {_WORDS},
windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM repeated) GROUP BY doc_id
),
lines AS (
    SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id),
counts AS (
    SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN line_counts USING (doc_id)
),
flags AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars
        OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words AS strict_failed
    FROM counts
),
hosts AS (
    SELECT source, count(*) AS n, sum(strict_failed::INT) AS f, sum(strict_failed::INT) / count(*) AS r
    FROM flags WHERE source IS NOT NULL GROUP BY source
),
prior AS (
    SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s
    FROM (SELECT avg(r) AS m, var_pop(r) AS v FROM hosts)
),
verdicts AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS host_poor FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (coalesce(host_poor, false) AND strict_failed) AS kept, coalesce(host_poor, false) AS host_poor
FROM flags LEFT JOIN verdicts USING (source)
"""

OP6 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
            WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM words)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT x, y FROM common JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, x AS y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
smallest AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""

OP10 = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '[^\n.!?。！？]*[\n.!?。！？]+\x20*|[^\n.!?。！？]+') AS us FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(us) AS u, unnest(range(1, len(us) + 1)) AS i FROM cut),
placed AS (
    SELECT *, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i) - length(u) AS b,
        trim(regexp_replace(lower(u), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
    FROM units
),
named AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM placed WHERE norm <> ''),
repeated AS (SELECT *, len(string_split(norm, ' ')) AS n_words FROM named QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1),
islands AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM repeated),
runs AS (
    SELECT doc_id, min(b) AS s, max(b + length(u)) AS e FROM islands GROUP BY doc_id, run
    HAVING sum(n_words) >= 40 OR sum(length(norm) - n_words + 1) >= 240
),
spans AS (SELECT doc_id, count(*) AS n_removed, string_agg(s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s) AS removed FROM runs GROUP BY doc_id),
rest AS (
    SELECT p.doc_id, coalesce(string_agg(u, '' ORDER BY i) FILTER (r.doc_id IS NULL), '') AS rest
    FROM placed p LEFT JOIN runs r ON p.doc_id = r.doc_id AND p.b >= r.s AND p.b < r.e GROUP BY p.doc_id
)
SELECT doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
    length(coalesce(rest, text))::BIGINT AS kept_chars, sha256(coalesce(rest, text)) AS kept_sha256
FROM documents LEFT JOIN spans USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

OP8 = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM valid q JOIN valid d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""

OP11 = """
WITH RECURSIVE valid AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 END
),
reach AS (SELECT x, x AS y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
smallest AS (SELECT x AS vec_id, min(y) AS c FROM reach GROUP BY x),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN smallest USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

OP13 = """
WITH valid AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
        list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM valid a JOIN valid d ON a.vec_id <> d.vec_id AND len(a.v) = len(d.v) WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES = {"op8_topk": OP8, "op6_near_dup": OP6, "op7_quality": OP7, "op10_line_dedup": OP10, "op11_quantised": OP11, "op13_hard_negatives": OP13}
