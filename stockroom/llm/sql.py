"""DuckDB SQL with the same rows as the queries of this subpackage, where SQL can express them.

The others: packing and piece ids need tokenizer files, compression bands zstandard, tool calls JSON in canonical form; importance resampling, toxicity, languages
and vectors are models. tests/llm holds these against brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from .urls import DAMPING, MARGIN, RULES

_NEAR_DUPLICATES = r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, hash(list_sort(s)) AS print FROM s),
rep AS (SELECT n_shingles, print, min(doc_id) AS rep FROM n WHERE n_shingles > 0 GROUP BY 1, 2),
e AS (SELECT doc_id, unnest(s) AS sh FROM s WHERE doc_id IN (SELECT rep FROM rep)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n_shingles + b.n_shingles - i)
  UNION SELECT rep, doc_id FROM n JOIN rep USING (n_shingles, print) WHERE rep <> doc_id),
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.doc_id WHERE r.root < b.v),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def _link_graph() -> str:
    host = "translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    given = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
j AS (SELECT *, CASE {rule} END AS rule, CASE {given} END AS given FROM u),
l AS (SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM u),
g AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
b AS (SELECT 'trust' AS kind, src AS from_, dst AS to_, n FROM g UNION ALL SELECT 'distrust', dst, src, n FROM g),
flow AS (SELECT kind, from_, to_, n::DOUBLE / sum(n) OVER (PARTITION BY kind, from_) AS share FROM b),
k AS (SELECT host, given, count(*) AS n FROM j WHERE given IS NOT NULL AND host <> '' GROUP BY 1, 2),
seed AS (SELECT CASE given WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, (1 - {DAMPING}::DOUBLE) * n / (SELECT sum(n) FROM k)::DOUBLE AS score FROM k),
step AS (SELECT 0 AS i, kind, host, score FROM seed UNION ALL SELECT i + 1, s.kind, f.to_, sum({DAMPING} * s.score * f.share) FROM step s JOIN flow f ON f.kind = s.kind AND f.from_ = s.host WHERE i < 400 GROUP BY 1, 2, 3),
h AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM step GROUP BY 1)
SELECT page_id, j.host, path, rule, coalesce(given, CASE WHEN distrust > trust * (1 + {MARGIN}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN h ON h.host = j.host
"""


_LEXICAL_SEARCH = r"""
WITH
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
l AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY 1),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
f AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT item_id, term, repeats * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM q JOIN f USING (term), g),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM w JOIN d USING (term) JOIN l USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

_HARD_NEGATIVES = """
WITH
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


SQL: dict[str, str] = {"op1_minhash_dedup": _NEAR_DUPLICATES, "op7_link_graph": _link_graph(), "op12_lexical_search": _LEXICAL_SEARCH, "op13_hard_negatives": _HARD_NEGATIVES}
