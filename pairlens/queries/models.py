"""Queries that fit models or call a completer, with the offline stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.config import DatasetConfig, JobConfig, SelectionConfig
from pairlens.functions.special import pearson_p_value
from pairlens.functions.text import pairwise_text, text_key
from pairlens.lineage import cut_lineage
from pairlens.operators import annotate, joins, linear, probe, stats
from pairlens.operators.activations import firing_rates
from pairlens.operators.completion import HashingEmbedder, lexical_completer
from pairlens.operators.dedup import augment_signs, unique_texts
from pairlens.operators.embed import embed_texts
from pairlens.operators.encoder import encode
from pairlens.operators.encoder_fit import FitConfig, fit_encoder
from pairlens.operators.interpret import InterpretConfig, abbreviate, interpret
from pairlens.operators.split import component_split
from pairlens.plans.features import run_job, select_and_probe
from pairlens.plans.preprocess import sampled_pair_texts
from pairlens.plans.reward import reward_baselines
from pairlens.queries.crc import crc32_sql
from pairlens.queries.features import CONCEPTS, DIMS, acts, binary_rows
from pairlens.queries.pairs import SPLIT_ON, deltas, stored_deltas
from pairlens.queries.registry import STEPS, first_words, p_value_sql, query, responses_sql, strip_sql
from pairlens.sources import derived
from pairlens.sources.derived import one_hot_params, table


def _dataset(sf_dir):
    return DatasetConfig("derived", sf_dir, SPLIT_ON)


def _pair_tasks(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir)
    text = pairwise_text(F.lit("-"), F.col("response_A"), F.col("response_B"), include_prompt=False)
    return prefs.select("row_id", text.alias("text")).withColumn("text_key", text_key(F.col("text")))


_CUT = """, cut AS (SELECT *, {a} AS a, {b} AS b FROM prefs)"""


def _annotated_pairs_sql() -> str:
    cut = _CUT.format(a=first_words("response_A", 128), b=first_words("response_B", 128))
    return cut + f"""SELECT DISTINCT sha256({responses_sql()}) AS text_key, sha256(concept) AS concept_key,
        CAST(CASE concept WHEN '{CONCEPTS[0]}' THEN sign(length(a) - length(b))
          ELSE sign(length(a) - length(replace(a, ',', '')) - length(b) + length(replace(b, ',', ''))) END AS INTEGER) AS annotation
        FROM cut, (VALUES ('{CONCEPTS[0]}'), ('{CONCEPTS[1]}')) c(concept)"""


@query(_annotated_pairs_sql(), ("prefs",))
def pairs_annotated_one_by_one(spark, sf_dir):
    texts = _pair_tasks(spark, sf_dir).select("text_key", "text").distinct()
    return annotate.annotate(joins.text_concept_tasks(texts, CONCEPTS), lexical_completer)


@query(_annotated_pairs_sql(), ("prefs",))
def pairs_annotated_as_matrix(spark, sf_dir):
    texts = _pair_tasks(spark, sf_dir).select("text_key", "text").distinct()
    return annotate.annotate_matrix(texts, CONCEPTS, lexical_completer)


@query(_annotated_pairs_sql(), ("prefs",))
def pairs_annotated_all_at_once(spark, sf_dir):
    texts = _pair_tasks(spark, sf_dir).select("text_key", "text").distinct()
    return annotate.annotate_multi(texts, CONCEPTS, lexical_completer)


@query(f"SELECT DISTINCT sha256(text) AS text_key, {DIMS} AS dims FROM documents WHERE {strip_sql('text')} <> ''")
def embedded_texts(spark, sf_dir):
    texts = unique_texts(table(spark, sf_dir, "documents"), F.col("text"))
    return embed_texts(texts, HashingEmbedder(DIMS), "hashing").select("text_key", F.size("embedding").alias("dims"))


_EMBEDDED = f"""WITH texts AS (SELECT DISTINCT text FROM documents WHERE {strip_sql('text')} <> ''),
  spoken AS (SELECT text, unnest(regexp_extract_all(text, '\\S+')) AS word FROM texts),
  hashed AS (SELECT word, {crc32_sql('word')} AS h FROM (SELECT DISTINCT word FROM spoken)),
  sums AS (SELECT text, h % {DIMS} AS pos, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v
    FROM spoken JOIN hashed USING (word) GROUP BY text, h % {DIMS}),
  norms AS (SELECT text, sqrt(sum(v * v))::FLOAT AS norm FROM sums GROUP BY text)
  SELECT sha256(text) AS text_key, pos::INTEGER AS pos, (v::FLOAT / norm)::DOUBLE AS value FROM sums JOIN norms USING (text) WHERE v <> 0"""


@query(_EMBEDDED)
def embedded_vectors(spark, sf_dir):
    """The components that are not zero of every text's vector."""
    texts = unique_texts(table(spark, sf_dir, "documents"), F.col("text"))
    found = embed_texts(texts, HashingEmbedder(DIMS), "hashing").select("text_key", F.posexplode("embedding").alias("pos", "value"))
    return found.filter("value <> 0").select("text_key", "pos", F.col("value").cast("double").alias("value"))


@query(
    """SELECT doc_id, trim(regexp_replace(regexp_replace('is the ' || source || ' at ' || lang, '\\b(is|the|at)\\b', '', 'g'), ' +', ' ', 'g'))
       AS abbreviated_interpretation FROM documents"""
)
def abbreviated_descriptions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("is the "), "source", F.lit(" at "), "lang").alias("interpretation")
    )
    return abbreviate(docs, lexical_completer).select("doc_id", "abbreviated_interpretation")


@query()
def generated_descriptions(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir)
    cfg = InterpretConfig()
    return interpret(
        acts(spark, sf_dir), lambda samples: sampled_pair_texts(prefs, samples, _dataset(sf_dir)), cfg, lexical_completer
    )


@query(
    f""", long AS (SELECT neuron_idx, act::double AS act, label FROM acts JOIN prefs USING (row_id) WHERE label IN (0, 1)),
    r AS (SELECT neuron_idx, corr(act, label) AS c, count(*) AS n FROM long GROUP BY neuron_idx), {STEPS}
    SELECT neuron_idx, round(coalesce(c, 'nan'::double), 6) AS correlation, n,
      round(coalesce({p_value_sql('c', 'n')}, 'nan'::double), 6) AS p_value FROM r""",
    ("acts",),
)
def correlation_p_values(spark, sf_dir):
    long = binary_rows(spark, sf_dir).select("label", F.posexplode("acts").alias("neuron_idx", "act"))
    r = long.groupBy("neuron_idx").agg(
        F.coalesce(stats.pearson(F.col("act"), F.col("label")), F.lit(float("nan"))).alias("correlation"),
        F.count(F.lit(1)).alias("n"),
    )
    tested = r.withColumn("p_value", pearson_p_value(F.col("correlation"), F.col("n")))
    return tested.withColumns({c: F.round(c, 6) for c in ("correlation", "p_value")})


@query()
def fitted_encoder_activity(spark, sf_dir):
    d = stored_deltas(spark, sf_dir)
    params, _ = fit_encoder(augment_signs(d), d, FitConfig())
    return firing_rates(encode(d, params)).select("neuron_idx", "prevalence")


def _split_rows(spark, sf_dir):
    rows = derived.measured(spark, sf_dir)
    sides = component_split(rows, SPLIT_ON).select("row_id", "split")
    joined = cut_lineage(binary_rows(spark, sf_dir, rows).join(sides, "row_id"))
    return joined.filter("split = 'train'"), joined.filter("split = 'val'")


@query()
def delta_probe(spark, sf_dir):
    pairs = derived.measured(spark, sf_dir)
    labelled = pairs.filter(stats.is_binary_label(F.col("label"))).select("row_id", "label")
    sides = component_split(pairs, SPLIT_ON).select("row_id", "split")
    rows = labelled.join(sides, "row_id").join(deltas(spark, sf_dir, pairs), "row_id").select(
        "row_id", "label", "split", probe.feature_vector(F.col("delta")).alias("features")
    ).persist()
    return probe.linear_probe(rows.filter("split = 'train'"), rows.filter("split = 'val'"))


# Newton's method on (1, control, activation) for each neuron, its 3 x 3 systems by Cramer's rule.
_NEWTON = """, raw AS (SELECT neuron_idx, label AS y, length_delta::double AS c, act::double AS a
    FROM acts JOIN rows USING (row_id) WHERE label IN (0, 1)),
  scaled AS MATERIALIZED (SELECT neuron_idx, y, (c - avg(c) OVER w) / stddev_pop(c) OVER w AS c,
    (a - avg(a) OVER w) / nullif(stddev_pop(a) OVER w, 0) AS a FROM raw WINDOW w AS (PARTITION BY neuron_idx)),
  newton AS (SELECT DISTINCT neuron_idx, 0 AS step, 0.0::double AS b0, 0.0::double AS b1, 0.0::double AS b2 FROM scaled
    UNION ALL SELECT neuron_idx, step + 1,
      b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d,
      b1 + (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d,
      b2 + (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d
    FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d
      FROM (SELECT neuron_idx, step, b0, b1, b2, sum(y - p) AS g0, sum((y - p) * c) AS g1, sum((y - p) * a) AS g2,
          sum(p * (1 - p)) AS h00, sum(p * (1 - p) * c) AS h01, sum(p * (1 - p) * a) AS h02, sum(p * (1 - p) * c * c) AS h11,
          sum(p * (1 - p) * c * a) AS h12, sum(p * (1 - p) * a * a) AS h22
        FROM (SELECT neuron_idx, step, b0, b1, b2, y, c, a, 1 / (1 + exp(-(b0 + b1 * c + b2 * a))) AS p
          FROM newton JOIN scaled USING (neuron_idx) WHERE step < 25)
        GROUP BY neuron_idx, step, b0, b1, b2)))
  SELECT neuron_idx, round(b2, 6) AS coef FROM newton WHERE step = 25"""


@query(_NEWTON, ("acts", "rows"))
def controlled_logit_coefficients(spark, sf_dir):
    return linear.controlled_coefs(binary_rows(spark, sf_dir), ["length_delta"]).withColumn("coef", F.round("coef", 6))


_RIDGE = """, xy AS (SELECT row_id, label AS y, length_delta::double AS c, act::double AS a FROM acts JOIN rows USING (row_id) WHERE neuron_idx = 0),
  m AS (SELECT avg(y) AS my, avg(c) AS mc, avg(a) AS ma, stddev_pop(c) AS sc, stddev_pop(a) AS sa, count(*) AS n,
    covar_pop(c, y) / stddev_pop(c) AS cy, covar_pop(a, y) / stddev_pop(a) AS ay, corr(c, a) AS ca FROM xy),
  b AS (SELECT *, 1 + 1.5 / n AS one, ((1 + 1.5 / n) ** 2 - ca * ca) AS d FROM m),
  w AS (SELECT *, (one * cy - ca * ay) / d AS wc, (one * ay - ca * cy) / d AS wa FROM b)
  SELECT row_id, round(my + wc * (c - mc) / sc + wa * (a - ma) / sa, 6) AS score FROM xy, w"""


@query(_RIDGE, ("acts", "rows"))
def ridge_probe_scores(spark, sf_dir):
    """Length and the first activation as predictors of the numeric label (0, 0.5, 1)."""
    pairs = derived.measured(spark, sf_dir)
    rows = pairs.select("row_id", "label", "length_delta").join(acts(spark, sf_dir, pairs), "row_id")
    first = rows.select("row_id", "label", probe.feature_vector(F.array("length_delta"), F.slice("acts", 1, 1)).alias("features")).persist()
    scores = probe.probe_scores(probe.fit_probe(first, c=1.5, binary=False), first)
    return scores.select("row_id", F.round("score", 6).alias("score"))


@query()
def controlled_lasso_selection(spark, sf_dir):
    return linear.controlled_lasso(binary_rows(spark, sf_dir), 3, ["length_delta"]).table(spark)


@query()
def plain_lasso_selection(spark, sf_dir):
    return linear.lasso_select(binary_rows(spark, sf_dir), 3, classification=True).table(spark)


@query()
def selection_sweep(spark, sf_dir):
    train, val = _split_rows(spark, sf_dir)
    cfg = SelectionConfig(lasso_top_k=[2, 5])
    return select_and_probe(train, val, list(range(8)), cfg).aucs


@query()
def reward_baseline_scores(spark, sf_dir):
    prefs = derived.preferences(spark, sf_dir, counted=True)
    scores = prefs.select("row_id", F.col("chars_A").alias("score_A"), F.col("chars_B").alias("score_B"))
    return reward_baselines(
        prefs, _dataset(sf_dir), HashingEmbedder(DIMS), "hashing", one_hot_params(DIMS, 16, 0.05), scores
    )


def _job(spark, sf_dir):
    """The whole job with its default sizes."""
    return run_job(
        spark, JobConfig(_dataset(sf_dir)), HashingEmbedder(DIMS), lexical_completer, derived.preferences(spark, sf_dir)
    )


@query()
def feature_report(spark, sf_dir):
    """The feature table of the whole job, with the offline stand-ins."""
    return _job(spark, sf_dir).features


@query()
def run_summary(spark, sf_dir):
    """(metric, value): quality and predictive metrics of the whole job."""
    result = _job(spark, sf_dir)
    return result.summary.unionByName(result.selections.aucs)
