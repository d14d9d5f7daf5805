"""Registration of queries and the SQL fragments their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlens.functions.text import LEFT_MARK, RIGHT_MARK

Query = Callable[[SparkSession, str], DataFrame]

# The blanks of pairlens.functions.text, spelled out for the SQL side.
BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{BLANKS}]+"
WORD_WITH_LEAD = f"[{BLANKS}]*[^{BLANKS}]+"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its name; ``ctes`` names shared fragments, in order of use."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_ctes(sql, ctes)
        return fn

    return register


def with_ctes(sql: str, names: tuple[str, ...]) -> str:
    parts: dict[str, str] = {}

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        parts.setdefault(name, CTES[name])

    for name in names:
        need(name)
    if not parts:
        return sql
    recursive = "RECURSIVE " if "components" in parts or "newton AS (" in sql else ""
    # A query may open with a comma to add fragments of its own.
    return f"WITH {recursive}" + ",\n".join(parts.values()) + "\n" + sql


def words(text: str) -> str:
    """SQL for the number of words of a text expression."""
    return f"len(regexp_extract_all({text}, '{WORD}'))"


def first_words(text: str, n: int) -> str:
    tokens = f"regexp_extract_all({text}, '{WORD_WITH_LEAD}')"
    return (
        f"CASE WHEN NOT ends_with({text}, '{RIGHT_MARK}') AND len({tokens}) > {n} "
        f"THEN array_to_string({tokens}[1:{n}], '') || '{RIGHT_MARK}' ELSE {text} END"
    )


def last_words(text: str, n: int) -> str:
    tokens = f"regexp_extract_all({text}, '{WORD_WITH_LEAD}')"
    kept = f"regexp_replace(array_to_string({tokens}[-{n}:], ''), '^[{BLANKS}]+', '')"
    return (
        f"CASE WHEN NOT starts_with({text}, '{LEFT_MARK}') AND len({tokens}) > {n} "
        f"THEN '{LEFT_MARK}' || {kept} || regexp_extract({text}, '[{BLANKS}]*$') ELSE {text} END"
    )


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def human(prompt: str) -> str:
    return f"CASE WHEN starts_with({prompt}, 'Human: ') THEN {prompt} ELSE 'Human: ' || {prompt} END"


def pair_sql(n: int = 128) -> str:
    """SQL for the rendered comparison of a row of ``prefs``."""
    return (
        f"'CONTEXT: \"' || ({last_words('(' + human('prompt') + ')', n)}) || '\"' || chr(10) || chr(10) || {responses_sql(n)}"
    )


def responses_sql(n: int = 128) -> str:
    gap = "chr(10) || chr(10)"
    return (
        f"'RESPONSE A: \"Assistant: ' || ({first_words('response_A', n)}) || '\"' || {gap} || "
        f"'RESPONSE B: \"Assistant: ' || ({first_words('response_B', n)}) || '\"'"
    )


def p_value_sql(r: str, n: str) -> str:
    """SQL for the two-sided p-value of correlation r over n points, over a fragment ``steps``.

    With r = sin(t) the tail of Student's distribution is the share of the integral of
    cos(x) ** (n - 3) that lies beyond t, taken here in 20 000 middle points.
    """
    beyond = f"(pi() / 2 - asin(abs({r})))"
    tail = f"sum(pow(cos(asin(abs({r})) + u * {beyond}), {n} - 3)) * {beyond}"
    return f"(SELECT {tail} / (pi() / 2 * sum(pow(cos(u * pi() / 2), {n} - 3))) FROM steps)"


STEPS = "steps AS (SELECT (range + 0.5::double) / 20000 AS u FROM range(20000))"

# Shared fragments. NEEDS lists what a fragment builds on.
NEEDS = {
    "prefs": ("labelled", "items", "base"),
    "base": ("labelled", "items"),
    "components": ("prefs",),
    "split": ("prefs", "components"),
    "deltas": ("prefs", "vectors"),
    "acts": ("prefs", "vectors", "deltas"),
    "rows": ("prefs",),
    "annotated": ("prefs",),
    "centroids": (),
    "bins": ("acts",),
}

CTES = {
    "labelled": """labelled AS (
  SELECT d.doc_id, d.text, d.source, l.quality FROM documents d JOIN labels l USING (doc_id))""",
    "items": "items AS (SELECT count(*) AS n FROM benchmark)",
    "base": """base AS MATERIALIZED (
  SELECT a.doc_id * 1000000 + b.doc_id AS pair_id,
         bm.text || ' #' || CAST(a.doc_id - a.doc_id % 20 AS string) || '-' || CAST(a.doc_id % 5 AS string) AS prompt,
         a.text AS response_A, b.text AS response_B,
         CASE WHEN a.quality > b.quality THEN 1.0::double WHEN a.quality < b.quality THEN 0.0::double
              ELSE 0.5::double END AS label,
         'c' || CAST(a.doc_id - a.doc_id % 20 AS string) || '-' || CAST(b.doc_id % 7 AS string) AS conversation_id,
         a.doc_id AS a_id, b.doc_id AS b_id
  FROM labelled a JOIN labelled b ON a.source = b.source AND b.doc_id > a.doc_id AND b.doc_id - a.doc_id <= 60
  CROSS JOIN items JOIN benchmark bm ON bm.item_id = a.doc_id % items.n)""",
    "prefs": """prefs AS (
  SELECT pair_id*4 AS row_id, prompt, response_A, response_B, label, conversation_id, a_id, b_id FROM base
  UNION ALL
  SELECT pair_id*4+1, prompt, response_B, response_A, 1-label, conversation_id, b_id, a_id FROM base WHERE pair_id % 5 = 0
  UNION ALL
  SELECT pair_id*4+2, prompt, response_A, response_B, 1-label, conversation_id, a_id, b_id FROM base WHERE pair_id % 7 = 0)""",
    "rows": f"""rows AS (
  SELECT *, {words('response_A')} - {words('response_B')} AS length_delta FROM prefs)""",
    "components": """touch AS (
  SELECT x.row_id AS a, y.row_id AS b FROM prefs x JOIN prefs y ON x.prompt = y.prompt
  UNION
  SELECT x.row_id, y.row_id FROM prefs x JOIN prefs y ON x.conversation_id = y.conversation_id),
reach(a, b) AS (
  SELECT a, b FROM touch UNION SELECT reach.a, touch.b FROM reach JOIN touch ON reach.b = touch.a),
components AS (SELECT a AS row_id, min(b) AS component FROM reach GROUP BY a)""",
    "split": """sizes AS (
  SELECT component, count(*) AS size, md5('42|' || component) AS h FROM components GROUP BY component),
placed AS (
  SELECT component,
         coalesce(sum(size) OVER (ORDER BY h, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(size) OVER () AS total FROM sizes),
split AS (
  SELECT row_id, component, CASE WHEN before < total * 0.8::double THEN 'train' ELSE 'val' END AS split
  FROM components JOIN placed USING (component))""",
    "vectors": """firsts AS MATERIALIZED (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
counted AS MATERIALIZED (SELECT count(*) AS n FROM embeddings),
vectors AS MATERIALIZED (
  SELECT f.doc_id, e.embedding FROM (SELECT doc_id, first_id % n AS vec_id FROM firsts, counted) f JOIN embeddings e USING (vec_id))""",
    "deltas": """deltas AS MATERIALIZED (
  SELECT p.row_id, list_transform(list_zip(va.embedding, vb.embedding), lambda z: z[1] - z[2]) AS delta
  FROM (SELECT row_id, a_id, b_id FROM prefs) p JOIN vectors va ON va.doc_id = p.a_id JOIN vectors vb ON vb.doc_id = p.b_id)""",
    "acts": """acts AS (
  SELECT row_id, CAST(i - 1 AS INTEGER) AS neuron_idx,
         CASE WHEN abs(delta[i]) > 0.1::float THEN delta[i] ELSE 0::float END AS act
  FROM deltas, (SELECT unnest(range(1, 9)) AS i))""",
    "bins": """bins AS (
  SELECT neuron_idx, quantile_cont(act::double, 0.0) AS p0, quantile_cont(act::double, 0.5) AS p50,
         quantile_cont(act::double, 0.9) AS p90, quantile_cont(act::double, 1.0) AS p100,
         quantile_cont(abs(act)::double, 0.95) AS m95, quantile_cont(abs(act)::double, 1.0) AS m100
  FROM acts WHERE act <> 0 GROUP BY neuron_idx)""",
    "centroids": """dims AS (SELECT unnest(range(1, 65)) AS i),
centroids AS (
  SELECT label, list(v ORDER BY i) AS embedding
  FROM (SELECT label, i, avg(embedding[i]::double) AS v FROM embeddings, dims GROUP BY label, i) GROUP BY label)""",
    "annotated": """annotated AS (
  SELECT row_id, 'is written at greater length' AS concept, sign(length(response_A) - length(response_B)) AS annotation FROM prefs
  UNION ALL
  SELECT row_id, 'lists things with commas',
         sign(length(response_A) - length(replace(response_A, ',', '')) - length(response_B) + length(replace(response_B, ',', '')))
  FROM prefs)""",
}
