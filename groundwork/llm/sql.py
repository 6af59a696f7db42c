"""SQL twins of the queries that SQL can express, over the tables of a data folder."""

from __future__ import annotations

from .chat_format import _PROBE, CONTROL, END, OPEN

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP9 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN)} + length({_escaped('r')}) + 3 + length({_escaped('x')}) + {len(END)}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

OP8 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
  li AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) x WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], chr(10)) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w) x),
  c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS m FROM g) y WHERE m > 1) z GROUP BY 1),
  m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(li.n, 0) AS n_lines, coalesce(li.d, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs FROM w LEFT JOIN li ON w.doc_id = li.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
  f AS (SELECT *, CAST((n_words < 20) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 30 * n_words) AS BIGINT) + 4 * CAST((100 * n_symbols > 25 * n_words) AS BIGINT) + 8 * CAST((100 * n_dup_lines > 60 * n_lines) AS BIGINT)
    + 16 * CAST((n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)) AS BIGINT) + 32 * CAST((100 * n_upper > 40 * word_chars) AS BIGINT) + 64 * CAST((100 * n_bangs > 25 * n_words) AS BIGINT) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failed % 4 > 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f"""

OP6 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], chr(10)) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w) x),
  r AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS m FROM g) y WHERE m > 1) z),
  p AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) x),
  k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i WHERE r.i IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, chr(10)) ELSE array_to_string(ws[i:i + 3], chr(10)) END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0) x),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  q AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a), c AS (SELECT a AS doc_id, min(b) AS component_id FROM q GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP7 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL), u AS MATERIALIZED (SELECT *, sqrt(list_inner_product(x, x)) AS n FROM v),
  e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.93),
  q AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT q.a, e.b FROM q JOIN e ON q.b = e.a), c AS (SELECT a, min(b) AS c FROM q GROUP BY 1), d AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id"""

OP12 = """WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.l = b.l AS same, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS s FROM v a JOIN v b ON a.id % 100 = 0 AND len(a.q) = len(b.q) AND (a.id, a.l, a.q) <> (b.id, b.l, b.q)),
  p AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same),
  n AS (SELECT p.a, p.b, p.s AS ps, s.b AS nb, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s WHERE p.r <= 5)
SELECT a AS anchor_id, b AS positive_id, CAST(r AS INTEGER) AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""

_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda v, x: list_reduce(list_prepend(xor(v, x), CAST(range(8) AS BIGINT[])), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"

OP13 = f"""WITH t AS (SELECT c, n, z, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, n) AS i FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS z, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL) x),
  h AS MATERIALIZED (SELECT c, c - c % 5 AS b, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t) x),
  r AS (SELECT h.c, 0 AS part, i, n, z FROM h JOIN t ON t.c = h.b AND t.i <= h.h UNION ALL SELECT h.c, 1, i, n, z FROM h JOIN t ON t.c = h.c AND t.i > h.h),
  s AS (SELECT h.c, coalesce(list(n ORDER BY part, i) FILTER (WHERE n IS NOT NULL), []) AS ns, coalesce(list(z ORDER BY part, i) FILTER (WHERE n IS NOT NULL), []) AS zs FROM h LEFT JOIN r ON h.c = r.c GROUP BY 1),
  p AS MATERIALIZED (SELECT c, d, md5(array_to_string(ns[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ns[1:d - 1], ',')) END AS pk, CASE WHEN d > 0 THEN zs[d] ELSE 0 END AS z, d = len(ns) AS last FROM (SELECT c, ns, zs, unnest(range(0, len(ns) + 1)) AS d FROM s) x),
  n AS MATERIALIZED (SELECT d, k, any_value(pk) AS pk, min(c) AS c, count(*) AS n, any_value(z) AS z, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS e FROM p GROUP BY d, k),
  m AS (SELECT d - 1 AS d, pk AS k, count(*) AS m FROM n WHERE d > 0 GROUP BY 1, 2),
  u AS (SELECT p.d, p.k, sum((n.n - 1) * n.z) AS s, count(*) FILTER (WHERE m.m IS NULL) AS l FROM n LEFT JOIN m ON n.d = m.d AND n.k = m.k JOIN p ON p.c = n.c AND p.d <= n.d GROUP BY 1, 2)
SELECT n.c AS conv_id, n.d AS depth, a.c AS parent_conv_id, n.n AS n_convs, coalesce(m.m, 0) AS n_children, u.l AS n_leaves, CAST(u.s AS BIGINT) AS saved_tokens, n.e AS ends_sha256
FROM n JOIN u ON u.d = n.d AND u.k = n.k LEFT JOIN m ON m.d = n.d AND m.k = n.k LEFT JOIN n a ON a.d = n.d - 1 AND a.k = n.pk"""

SQL = {"op6_substring_dedup": OP6, "op7_embedding_dedup": OP7, "op8_quality_rules": OP8, "op9_chat_format": OP9, "op10_minhash_dedup": OP10, "op12_bond_negatives": OP12, "op13_prefix_trie": OP13}
