"""Equivalent SQL where it can express the operator; the rest is tested in tests/llm against brute force."""

P4 = """
WITH latest AS (
  SELECT completion_id, _subset, overall_score,
         row_number() OVER (PARTITION BY completion_id ORDER BY ingested_at DESC, _subset DESC NULLS LAST, overall_score DESC NULLS LAST) AS rn
  FROM reasoning_completions WHERE completion_id IS NOT NULL),
scored AS (SELECT _subset, overall_score FROM latest WHERE rn = 1 AND _subset IS NOT NULL AND overall_score IS NOT NULL),
grid AS (
  SELECT s._subset, c.cutoff, count(*) FILTER (WHERE s.overall_score >= c.cutoff) AS n_kept, count(*) AS n, min(t.target_pct) AS pct
  FROM scored s JOIN subset_targets t USING (_subset) CROSS JOIN (SELECT unnest(range(1, 11)) AS cutoff) c
  GROUP BY s._subset, c.cutoff)
SELECT _subset, CAST(max(cutoff) AS INTEGER) AS cutoff, CAST(min(n_kept) AS BIGINT) AS n_kept
FROM grid WHERE n_kept * 100 >= n * pct GROUP BY _subset
"""

# All pairs that share a word at all, with the exact share of their bags: brute force, for tables of the size the check uses.
P2 = """
WITH doc AS (
  SELECT DISTINCT record_id, concat_ws(chr(10), query, answer, array_to_string(list_transform(coalesce(interactions, []), lambda x: concat_ws(chr(10), x.query, x.answer)), chr(10))) AS t
  FROM mrl_records WHERE record_id IS NOT NULL),
num AS (SELECT record_id, row_number() OVER () AS k, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM doc),
word AS (SELECT record_id, k, unnest(w) AS x FROM num),
bag AS (SELECT record_id, k, x, row_number() OVER (PARTITION BY k, x) AS o FROM word),
size AS (SELECT k, count(*) AS n FROM bag GROUP BY k),
shared AS (
  SELECT a.k AS ka, b.k AS kb, min(a.record_id) AS ia, min(b.record_id) AS ib, count(*) AS c
  FROM bag a JOIN bag b ON a.x = b.x AND a.o = b.o AND a.record_id < b.record_id GROUP BY a.k, b.k)
SELECT DISTINCT ia AS record_id_a, ib AS record_id_b FROM shared JOIN size x ON x.k = ka JOIN size y ON y.k = kb
WHERE c >= 0.8 * (x.n + y.n - c)
"""

# Connected classes of the pairs above.
P2_CLASSES = P2.strip().replace("WITH doc", "WITH RECURSIVE doc", 1).replace("SELECT DISTINCT ia AS", ", pair AS (SELECT DISTINCT ia AS", 1) + """),
ids AS (SELECT DISTINCT record_id AS id FROM bag),
edge AS (SELECT record_id_a AS a, record_id_b AS b FROM pair UNION ALL SELECT record_id_b, record_id_a FROM pair),
reach(id, root) AS (SELECT id, id FROM ids UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id)
SELECT i.id AS record_id, (SELECT min(root) FROM reach WHERE reach.id = i.id) AS class_id, (SELECT count(*) FROM edge WHERE edge.a = i.id) AS links FROM ids i
"""

# Words inside a three-word phrase that came earlier in the value.
P5 = """
WITH val AS (
  SELECT 'mrl_records' AS tbl, record_id AS row_key, -1 AS pos, answer AS t FROM mrl_records
  UNION SELECT 'reasoning_completions', completion_id, CAST(i - 1 AS INTEGER), interactions[i].think FROM reasoning_completions, unnest(range(1, len(interactions) + 1)) u(i)),
num AS (SELECT *, row_number() OVER () AS k FROM val WHERE t IS NOT NULL),
word AS (SELECT k, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM (SELECT k, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM num)),
gram AS (SELECT k, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY k ORDER BY i)),
seen AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY k, a, b, c ORDER BY i) AS n FROM gram WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT DISTINCT k, i + d AS i FROM seen, (VALUES (0), (1), (2)) v(d)),
share AS (SELECT word.k, count(covered.i) / count(*) AS s FROM word LEFT JOIN covered ON covered.k = word.k AND covered.i = word.i GROUP BY word.k)
SELECT DISTINCT tbl, row_key, pos FROM num JOIN share USING (k) WHERE s >= 0.4
"""

ORACLE: dict[str, str] = {"p2_found": P2, "p2_classes": P2_CLASSES, "p4_found": P4, "p5_found": P5}
