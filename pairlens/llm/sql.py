"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from pairlens.queries.crc import crc32_sql, digits_sql

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RUNS = """list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""
def _side(name: str, id: str) -> str:
    return f"""{name}_words AS (SELECT {id} AS id, row_number() OVER () AS rn, {WORDS} AS w FROM {name}),
{name}_features AS (SELECT rn, g, count(*) AS n FROM (SELECT rn, unnest({RUNS}) AS g FROM {name}_words) GROUP BY rn, g)"""
IMPORTANCE = f"""WITH {_side('documents','doc_id')},
{_side('benchmark','item_id')},
named AS (SELECT g, {crc32_sql('g')} % 10000 AS bucket FROM (SELECT g FROM documents_features UNION SELECT g FROM benchmark_features)),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM documents_features JOIN named USING (g) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM benchmark_features JOIN named USING (g) GROUP BY bucket),
gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)
  / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT rn, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM documents_features JOIN named USING (g) JOIN gains USING (bucket) GROUP BY rn),
noise AS (SELECT rn, id, len(w) AS n_words,
  list_reduce(list_prepend(0::BIGINT, {digits_sql("substring(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8)")}), lambda a, d: a * 16 + d) AS h
  FROM documents_words),
scored AS (SELECT id AS doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM noise LEFT JOIN weighed USING (rn)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place,
  floor(5 * (count(*) FILTER (n_words >= 20) OVER ()) / 100) AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS "rank" FROM ranked"""

# Conversation repair: the table of states is walked row by row, with the cheapest way (and of equally
# cheap ones the first audit) to each state.
SPOKEN = r"[^\x20\x09-\x0D]"
REPAIR = f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
fated AS (SELECT *, {crc32_sql("name")} % 20 AS fate FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
lines AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{SPOKEN}') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT contains('.!?', regexp_extract(text, '({SPOKEN})[\\x20\\x09-\\x0D]*$', 1)) THEN 'truncated' ELSE '' END AS fault,
  substring(role, 1, 1) AS initial, lead(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
measures AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM lines GROUP BY conv_id),
inserts(s, k, t, more) AS (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, chr(10) || 'user:'),
  (1, 1, 2, chr(10) || 'user:'), (2, 1, 3, chr(10) || 'assistant:'), (3, 1, 2, chr(10) || 'user:'),
  (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(edit, t, initial, goal, price, spoken) AS (
  SELECT 'D', t::INT, NULL::VARCHAR, t::INT, 3, NULL::VARCHAR FROM range(4) AS states(t)
  UNION ALL VALUES ('K', 0, 's', 1, 0, NULL::VARCHAR), ('K', 0, 'u', 2, 0, NULL::VARCHAR), ('K', 1, 'u', 2, 0, NULL::VARCHAR), ('K', 2, 'a', 3, 0, NULL::VARCHAR),
    ('K', 3, 'u', 2, 0, NULL::VARCHAR), ('R', 0, NULL::VARCHAR, 2, 2, 'user'), ('R', 1, NULL::VARCHAR, 2, 2, 'user'), ('R', 2, NULL::VARCHAR, 3, 2, 'assistant'),
    ('R', 3, NULL::VARCHAR, 2, 2, 'user')),
ways AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, '' AS said FROM convs
  UNION ALL SELECT conv_id, i, s, cost, audit, said FROM (
    SELECT w.conv_id, l.i, e.goal AS s, w.cost + 2 * n.k + e.price + (e.edit <> 'D' AND l.fault = 'truncated')::INT AS cost,
      w.audit || repeat('I', n.k) || e.edit AS audit,
      w.said || n.more || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.spoken, l.role) || ':' || l.text END AS said,
      row_number() OVER (PARTITION BY w.conv_id, e.goal
        ORDER BY w.cost + 2 * n.k + e.price + (e.edit <> 'D' AND l.fault = 'truncated')::INT, w.audit || repeat('I', n.k) || e.edit) AS best
    FROM ways AS w JOIN lines AS l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i + 1
    JOIN inserts AS n ON n.s = w.s JOIN edits AS e ON e.t = n.t
    WHERE (e.edit = 'D' OR l.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.initial = l.initial)) WHERE best = 1),
ends AS (SELECT w.conv_id, w.cost + 2 * n.k AS cost, w.audit || repeat('I', n.k) AS audit, w.said || n.more AS said,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * n.k, w.audit || repeat('I', n.k)) AS best
  FROM ways AS w LEFT JOIN measures AS m ON m.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts AS n ON n.s = w.s
  WHERE w.i = coalesce(m.n, 0) AND n.t IN (0, 3))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit,
  sha256(substring(said, 2)) AS repaired_sha256
FROM ends AS e LEFT JOIN measures AS m ON m.conv_id IS NOT DISTINCT FROM e.conv_id WHERE best = 1"""
