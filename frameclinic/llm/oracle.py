"""SQL for the registered queries that it can express on whole tables; the others are tested by brute force."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(column: str) -> str:
    return LOWER.format(f"coalesce({column}, '')")


# Shingles as lists of words; pairs by shared shingles; components by reachability.
OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct([w[i:i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM n LEFT JOIN least USING (doc_id)
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{_WORDS}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(g) AS n FROM win),
every AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM every JOIN win USING (g)),
place AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
"""

# The length of a written turn: marks, role and text, and one more for each character that gets a backslash.
OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, 4 + length(role) + len(regexp_extract_all(role, '[\\:]')) + 2 + length(text)
    + len(regexp_extract_all(text, '\\|</turn>')) + length(array_to_string(regexp_extract_all(text, '#{3,}'), '')) + 8 AS size
  FROM t),
p AS (
  SELECT *, sum(size) OVER w AS upto, lead(role) OVER w AS next_role, lead(turn) OVER w IS NULL AS is_last
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

# Every pair of usable vectors.
OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (
  SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len([e FOR e IN x IF e IS NULL OR NOT isfinite(e)]) = 0 AND list_inner_product(x, x) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
links AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  least(vec_id, coalesce(m, vec_id)) = vec_id AS kept
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN links USING (vec_id)
"""

OP9 = rf"""
WITH r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/]*')")} AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
f AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host) * 1000 + length(rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host) * 1000 + length(rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)
"""

# Windows as lists of words with the least document that starts them; a word goes if such a window covers it.
OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (g) WHERE m < doc_id),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# Pieces and words as lists; all phrases of one to three words counted; both cuts of three words compared.
OP12 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, unnest(w) AS phrase, 1 AS size FROM w
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), 2 FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]), 3 FROM w WHERE len(w) > 2),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS x FROM f WHERE size > 1 AND f >= 10),
k AS (
  SELECT lang, phrase, size, a, x, k, array_to_string(x[:k], ' ') AS lt, array_to_string(x[k + 1:], ' ') AS rt
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT k.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lt JOIN f r ON r.lang = k.lang AND r.phrase = rt),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
big AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, a, x[1] || ' ' || x[2] AS phrase FROM c WHERE size = 3
    UNION ALL SELECT lang, a, x[2] || ' ' || x[3] FROM c WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN big ON b.lang = big.lang AND b.phrase = big.phrase WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

# Every anchor against every usable row, in whole numbers.
OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
h AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 3
"""

ORACLE: dict[str, str] = {
    "op1_minhash_dedup": OP1,
    "op2_decontamination": OP2,
    "op6_chat_formatting": OP6,
    "op8_embedding_dedup": OP8,
    "op9_url_filter": OP9,
    "op11_substring_dedup": OP11,
    "op12_collocations": OP12,
    "op13_hard_negatives": OP13,
}
