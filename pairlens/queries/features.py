"""Queries over encoder activations: rates, quantiles, samples, fidelity, redundancy.

They use an encoder that copies eight vector components above a threshold, which SQL can follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.operators import activations, fidelity, sampling, stats
from pairlens.operators.encoder import EncoderParams, encode, reconstruction_loss
from pairlens.operators.encoder_fit import lower_medians
from pairlens.operators.linear import controlled_coefs
from pairlens.operators.ordered import exact_quantiles
from pairlens.operators.redundancy import redundancy
from pairlens.plans.features import feature_table
from pairlens.queries.pairs import deltas, stored_deltas
from pairlens.queries.registry import STEPS, p_value_sql, query
from pairlens.sources import derived
from pairlens.sources.derived import one_hot_params, table

DIMS = 64
CONCEPTS = ["is written at greater length", "lists things with commas"]


def acts(spark, sf_dir, rows=None):
    """Activations in a checkpoint, as the composite job keeps them: they are read many times."""
    return cut_lineage(encode(deltas(spark, sf_dir, rows), one_hot_params(DIMS)))


def _as_double(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("SELECT row_id, neuron_idx, act::double AS act FROM acts WHERE act <> 0", ("acts",))
def encoded_activations(spark, sf_dir):
    return _as_double(activations.long_activations(encode(deltas(spark, sf_dir), one_hot_params(DIMS))), "act")


@query("SELECT neuron_idx, round(avg(CASE WHEN act <> 0 THEN 1.0 ELSE 0.0 END), 9)::double AS prevalence FROM acts GROUP BY neuron_idx", ("acts",))
def firing_rates(spark, sf_dir):
    rates = activations.firing_rates(acts(spark, sf_dir))
    return rates.select("neuron_idx", F.round("prevalence", 9).alias("prevalence"))


@query(
    """, n AS (SELECT neuron_idx, sum(act::double) AS s, count(CASE WHEN act <> 0 THEN 1 END) AS fired, count(*) AS rows FROM acts GROUP BY neuron_idx)
    SELECT count(CASE WHEN s = 0 THEN 1 END) AS n_dead, count(CASE WHEN fired = 0 THEN 1 END) AS n_never_fired,
           round(sum(fired / rows), 9) AS mean_active_per_row FROM n""",
    ("acts",),
)
def activity_summary(spark, sf_dir):
    summary = activations.activity_summary(acts(spark, sf_dir))
    return summary.withColumn("mean_active_per_row", F.round("mean_active_per_row", 9))


@query(
    """SELECT neuron_idx, count(*) AS n, round(quantile_cont(act::double, 0.0), 6) AS p0, round(quantile_cont(act::double, 0.5), 6) AS p50,
       round(quantile_cont(act::double, 0.95), 6) AS p95, round(quantile_cont(act::double, 1.0), 6) AS p100
       FROM acts WHERE act <> 0 GROUP BY neuron_idx""",
    ("acts",),
)
def activation_quantiles(spark, sf_dir):
    long = activations.long_activations(acts(spark, sf_dir))
    q = exact_quantiles(long, ["neuron_idx"], "act", [0.0, 0.5, 0.95, 1.0])
    names = ["p0", "p50", "p95", "p100"]
    return q.select("neuron_idx", "n", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)])


@query(
    "SELECT CAST(i - 1 AS INTEGER) AS dim, quantile_disc(delta[i], 0.5)::double AS median FROM deltas, (SELECT unnest(range(1, 65)) AS i) GROUP BY i",
    ("deltas",),
)
def lower_median_per_dimension(spark, sf_dir):
    return _as_double(lower_medians(stored_deltas(spark, sf_dir)), "median")


_HASH = "md5({seed} || '|' || neuron_idx || '|' || row_id)"


@query(
    f"""SELECT neuron_idx, row_id, act::double AS act, 1 AS is_positive FROM acts
        QUALIFY row_number() OVER (PARTITION BY neuron_idx ORDER BY act DESC, row_id) <= 20
        UNION ALL
        SELECT neuron_idx, row_id, act::double, 0 FROM acts WHERE act = 0
        QUALIFY row_number() OVER (PARTITION BY neuron_idx ORDER BY {_HASH.format(seed="'7'")}, row_id) <= 20""",
    ("acts",),
)
def samples_top_and_zero(spark, sf_dir):
    return _as_double(sampling.sample_top_zero(acts(spark, sf_dir), 40, seed=7), "act")


def _bin(where: str, positive: int, n: int) -> str:
    return f"""SELECT neuron_idx, row_id, act::double AS act, {positive} AS is_positive FROM acts JOIN bins USING (neuron_idx)
        WHERE {where} QUALIFY row_number() OVER (PARTITION BY neuron_idx ORDER BY {_HASH.format(seed="neuron_idx")}, row_id) <= {n}"""


@query(
    _bin("act <> 0 AND act BETWEEN p50 AND p100", 1, 50) + " UNION ALL " + _bin("act <> 0 AND act BETWEEN p0 AND p50", 0, 50),
    ("bins",),
)
def samples_from_two_bins(spark, sf_dir):
    return _as_double(sampling.sample_percentile_bins(acts(spark, sf_dir), 100, (50, 100), (0, 50)), "act")


@query(_bin("act <> 0 AND act BETWEEN p90 AND p100", 1, 10) + " UNION ALL " + _bin("act = 0", 0, 10), ("bins",))
def samples_high_bin_and_silent(spark, sf_dir):
    return _as_double(sampling.sample_percentile_bins(acts(spark, sf_dir), 20), "act")


@query(
    f"""SELECT neuron_idx, candidate_idx, row_id, act::double AS act
        FROM acts JOIN bins USING (neuron_idx), (SELECT unnest([0, 1, 2])::INTEGER AS candidate_idx)
        WHERE act <> 0 AND abs(act) BETWEEN m95 AND m100
        QUALIFY row_number() OVER (PARTITION BY neuron_idx, candidate_idx ORDER BY {_HASH.format(seed="candidate_idx")}, row_id) <= 5""",
    ("bins",),
)
def samples_top_magnitude(spark, sf_dir):
    return _as_double(sampling.sample_top_only(acts(spark, sf_dir), 5, (95, 100), candidates=3), "act")


@query(
    f"""SELECT neuron_idx, 0 AS candidate_idx, row_id, act::double AS act FROM (SELECT * FROM acts
          QUALIFY row_number() OVER (PARTITION BY neuron_idx ORDER BY abs(act) DESC, row_id) <= 40)
        QUALIFY row_number() OVER (PARTITION BY neuron_idx ORDER BY {_HASH.format(seed="0")}, row_id) <= 10""",
    ("acts",),
)
def samples_from_strongest(spark, sf_dir):
    return _as_double(sampling.sample_top_only(acts(spark, sf_dir), 10, n_top=40), "act")


def annotations(rows):
    """Annotations a lexical annotator would give, one per measured pair and concept."""
    by_concept = F.array(
        F.struct(F.lit(CONCEPTS[0]).alias("c"), F.sign("chars_delta").alias("v")),
        F.struct(F.lit(CONCEPTS[1]).alias("c"), F.sign("commas_delta").alias("v")),
    )
    return rows.select(F.col("row_id").cast("string").alias("text_key"), F.explode(by_concept).alias("e")).select(
        "text_key", F.sha2("e.c", 256).alias("concept_key"), F.col("e.v").cast("int").alias("annotation")
    )


def interpretations(spark, n_neurons=8):
    rows = [(n, i, c) for n in range(n_neurons) for i, c in enumerate(CONCEPTS)]
    return spark.createDataFrame(rows, "neuron_idx int, candidate_idx int, interpretation string")


def _metrics(spark, sf_dir, rows=None, active=None):
    rows = derived.measured(spark, sf_dir) if rows is None else rows
    active = acts(spark, sf_dir, rows) if active is None else active
    samples = sampling.sample_percentile_bins(active, 100, (50, 100), (0, 50))
    samples = samples.withColumn("text_key", F.col("row_id").cast("string"))
    return fidelity.fidelity(samples, annotations(rows), interpretations(spark))


_METRICS = (
    ", samples AS ("
    + _bin("act <> 0 AND act BETWEEN p50 AND p100", 1, 50)
    + " UNION ALL "
    + _bin("act <> 0 AND act BETWEEN p0 AND p50", 0, 50)
    + """), metrics AS (SELECT neuron_idx, concept AS interpretation,
      CASE WHEN min(annotation) = max(annotation) THEN 0.0 ELSE round(corr(act, annotation::double), 6) END AS correlation,
      CASE WHEN min(annotation) >= 0 THEN avg(CASE WHEN is_positive = 1 THEN annotation END) ELSE 0.0 END AS recall,
      CASE WHEN min(annotation) >= 0 THEN 1 - avg(CASE WHEN is_positive = 0 THEN annotation END) ELSE 0.0 END AS precision
      ,CASE WHEN min(annotation) < max(annotation) THEN corr(act, annotation::double) END AS r, count(*) AS n
    FROM samples JOIN annotated USING (row_id) GROUP BY neuron_idx, concept), """
    + STEPS
    + f", tested AS (SELECT *, coalesce({p_value_sql('r', 'n')}, 1.0) AS p_value FROM metrics) "
)


@query(
    _METRICS
    + """SELECT neuron_idx, interpretation, correlation, round(recall, 6) AS recall, round(precision, 6) AS precision,
       CASE WHEN recall + precision > 0 THEN round(2 * recall * precision / (recall + precision), 6) ELSE 0.0 END AS f1, round(p_value, 6) AS p_value FROM tested""",
    ("bins", "annotated"),
)
def description_fidelity(spark, sf_dir):
    m = _metrics(spark, sf_dir).drop("candidate_idx")
    return m.withColumns({c: F.round(c, 6) for c in ("correlation", "recall", "precision", "f1", "p_value")})


_BEST = _METRICS + """, best AS (SELECT neuron_idx, interpretation, correlation, p_value FROM tested
    QUALIFY row_number() OVER (PARTITION BY neuron_idx ORDER BY correlation DESC, interpretation) = 1)"""


@query(_BEST + "SELECT neuron_idx, interpretation, correlation FROM best", ("bins", "annotated"))
def best_descriptions(spark, sf_dir):
    best = fidelity.best_candidates(_metrics(spark, sf_dir))
    return best.select("neuron_idx", "interpretation", F.round("correlation", 6).alias("correlation"))


@query(_BEST + "SELECT neuron_idx FROM best WHERE correlation >= 0.02", ("bins", "annotated"))
def faithful_features(spark, sf_dir):
    best = fidelity.best_candidates(_metrics(spark, sf_dir))
    return fidelity.faithful(best, 0.02, None).select("neuron_idx")


@query(_BEST + "SELECT neuron_idx, p_value <= 0.05 / 32 AS strictly FROM best WHERE correlation >= 0.02 AND p_value <= 0.5", ("bins", "annotated"))
def significant_features(spark, sf_dir):
    best = fidelity.best_candidates(_metrics(spark, sf_dir))
    strict = fidelity.faithful(best, 0.02).select("neuron_idx", F.lit(True).alias("strictly"))
    return fidelity.faithful(best, 0.02, 0.5).select("neuron_idx").join(strict, "neuron_idx", "left").fillna(False)


@query(_BEST + "SELECT round(avg(abs(correlation)), 5) AS mean_abs_correlation FROM best", ("bins", "annotated"))
def mean_abs_fidelity(spark, sf_dir):
    best = fidelity.best_candidates(_metrics(spark, sf_dir))
    return fidelity.mean_abs_correlation(best).select(F.round("mean_abs_correlation", 5).alias("mean_abs_correlation"))


def centroids(spark, sf_dir):
    """(id, text, embedding): the mean vector of every class of the embeddings table."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    means = long.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(F.col("label").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("embedding")
    ).withColumn("text", F.concat(F.lit("class "), "id"))


_SIMS = """, sims AS (SELECT a.label AS a, b.label AS b, CASE WHEN a.label = b.label THEN 0.0
      ELSE list_cosine_similarity(a.embedding, b.embedding) END AS s FROM centroids a, centroids b)"""


@query(
    _SIMS + """SELECT a::bigint AS id, round(max(s), 6) AS semantic_redundancy, 'class ' || arg_max(b, (s, -b)) AS semantic_neighbor
       FROM sims GROUP BY a""",
    ("centroids",),
)
def concept_redundancy(spark, sf_dir):
    closest, _ = redundancy(centroids(spark, sf_dir), 0.1)
    return closest.withColumn("semantic_redundancy", F.round("semantic_redundancy", 6))


@query(
    _SIMS
    + """, hop1 AS (SELECT a, b FROM sims WHERE s > 0.1 UNION SELECT label, label FROM centroids),
      hop2 AS (SELECT DISTINCT x.a, y.b FROM hop1 x JOIN hop1 y ON x.b = y.a),
      hop4 AS (SELECT DISTINCT x.a, y.b FROM hop2 x JOIN hop2 y ON x.b = y.a),
      hop8 AS (SELECT DISTINCT x.a, y.b FROM hop4 x JOIN hop4 y ON x.b = y.a),
      hop16 AS (SELECT DISTINCT x.a, y.b FROM hop8 x JOIN hop8 y ON x.b = y.a)
      SELECT count(DISTINCT m) AS n_components FROM (SELECT a, min(b) AS m FROM hop16 GROUP BY a)""",
    ("centroids",),
)
def semantic_components(spark, sf_dir):
    _, n = redundancy(centroids(spark, sf_dir), 0.1)
    return spark.range(1).select(F.lit(n).cast("long").alias("n_components"))


@query(
    """, sq AS (SELECT row_id, i, delta[i]::double AS x, CASE WHEN i <= 8 AND abs(delta[i]) > 0.1::float THEN delta[i]::double ELSE 0.0 END AS p
      FROM deltas, (SELECT unnest(range(1, 65)) AS i))
    SELECT round(sum(err) / sum(base), 9) AS nmse FROM (
      SELECT i, sum((x - p) ** 2) AS err, var_pop(x) * count(*) AS base FROM sq GROUP BY i)""",
    ("deltas",),
)
def normalised_reconstruction_error(spark, sf_dir):
    d = stored_deltas(spark, sf_dir)
    decoded = encode(d, one_hot_params(DIMS)).select(
        "row_id", F.concat("acts", F.array_repeat(F.lit(0.0).cast("float"), DIMS - 8)).alias("predicted")
    )
    nmse = stats.normalised_mse(d.join(decoded, "row_id"), "delta", "predicted")
    return nmse.select(F.round("nmse", 9).alias("nmse"))


@query(
    """, placed AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS r, count(*) OVER () AS n, delta FROM deltas),
    sliced AS (SELECT CASE WHEN r < (n % 32) * (n // 32 + 1) THEN r // (n // 32 + 1)
                 ELSE n % 32 + (r - (n % 32) * (n // 32 + 1)) // (n // 32) END AS slice, delta FROM placed),
    sq AS (SELECT slice, i, delta[i]::double AS x,
             CASE WHEN i <= 4 AND abs(delta[i]) > 0.1::float THEN delta[i]::double ELSE 0.0 END AS p4,
             CASE WHEN i <= 8 AND abs(delta[i]) > 0.1::float THEN delta[i]::double ELSE 0.0 END AS p8
           FROM sliced, (SELECT unnest(range(1, 65)) AS i)),
    dims AS (SELECT slice, i, sum((x - p4) ** 2) AS e4, sum((x - p8) ** 2) AS e8, var_pop(x) * count(*) AS base FROM sq GROUP BY slice, i)
    SELECT round(avg(loss), 8) AS reconstruction_loss FROM (SELECT slice, (sum(e4) + sum(e8)) / 2 / sum(base) AS loss FROM dims GROUP BY slice)""",
    ("deltas",),
)
def reconstruction_loss_over_slices(spark, sf_dir):
    p = one_hot_params(DIMS, threshold=float(np.float32(0.1)))
    params = EncoderParams(p.enc, p.dec, p.input_bias, p.neuron_bias, p.threshold, p.k, [4, 8])
    loss = reconstruction_loss(stored_deltas(spark, sf_dir), params)
    return loss.select(F.round("reconstruction_loss", 8).alias("reconstruction_loss"))


def binary_rows(spark, sf_dir, rows=None, active=None):
    """(row_id, label, length_delta, acts) of rows with a binary label."""
    rows = derived.measured(spark, sf_dir) if rows is None else rows
    active = acts(spark, sf_dir, rows) if active is None else active
    return rows.filter(stats.is_binary_label(F.col("label"))).select("row_id", "label", "length_delta").join(active, "row_id")


@query(
    """, xy AS (SELECT neuron_idx, label AS y, length_delta::double AS c, act::double AS a
         FROM acts JOIN rows USING (row_id) WHERE label IN (0, 1))
    SELECT neuron_idx, round(stddev_pop(a) * (covar_pop(a, y) * var_pop(c) - covar_pop(c, y) * covar_pop(a, c))
           / (var_pop(a) * var_pop(c) - covar_pop(a, c) ** 2), 6) AS coef FROM xy GROUP BY neuron_idx""",
    ("acts", "rows"),
)
def length_controlled_slopes(spark, sf_dir):
    coefs = controlled_coefs(binary_rows(spark, sf_dir), ["length_delta"], classification=False)
    return coefs.select("neuron_idx", F.round("coef", 6).alias("coef"))


def _assembled(spark, sf_dir):
    rows = derived.measured(spark, sf_dir)
    a = acts(spark, sf_dir, rows)
    best = cut_lineage(fidelity.best_candidates(_metrics(spark, sf_dir, rows, a)))
    kept = fidelity.faithful(best, 0.02, None)
    short = best.select("neuron_idx", F.upper("interpretation").alias("abbreviated_interpretation"))
    near = centroids(spark, sf_dir).select(
        "id", F.col("embedding")[0].alias("semantic_redundancy"), F.col("text").alias("semantic_neighbor")
    )
    coefs = controlled_coefs(binary_rows(spark, sf_dir, rows, a), ["length_delta"], classification=False)
    # Two neurons more than the encoder has: they must appear with empty fields.
    return feature_table(10, best, kept, short, activations.firing_rates(a), near, coefs)


_FEATURES = (
    _BEST
    + """, rates AS (SELECT neuron_idx, avg(CASE WHEN act <> 0 THEN 1.0 ELSE 0.0 END) AS prevalence FROM acts GROUP BY neuron_idx),
    xy AS (SELECT neuron_idx, label AS y, length_delta::double AS c, act::double AS a
         FROM acts JOIN rows USING (row_id) WHERE label IN (0, 1)),
    slopes AS (SELECT neuron_idx, stddev_pop(a) * (covar_pop(a, y) * var_pop(c) - covar_pop(c, y) * covar_pop(a, c))
           / (var_pop(a) * var_pop(c) - covar_pop(a, c) ** 2) AS coef FROM xy GROUP BY neuron_idx),
    assembled AS (SELECT CAST(n AS INTEGER) AS neuron_idx, interpretation, coalesce(upper(interpretation), '') AS abbreviated_interpretation,
      round(prevalence, 6)::double AS prevalence, correlation, coalesce(correlation >= 0.02, false) AS kept,
      round(embedding[1], 6) AS semantic_redundancy, 'class ' || label AS semantic_neighbor,
      round(coef, 6) AS length_controlled_logit_coef
    FROM (SELECT unnest(range(10)) AS n) LEFT JOIN best ON best.neuron_idx = n LEFT JOIN rates ON rates.neuron_idx = n
      LEFT JOIN centroids ON label = n LEFT JOIN slopes ON slopes.neuron_idx = n)"""
)


def _rounded(features):
    numbers = ("prevalence", "correlation", "semantic_redundancy", "length_controlled_logit_coef")
    return features.drop("p_value").withColumns({c: F.round(c, 6) for c in numbers})


@query(_FEATURES + "SELECT * FROM assembled", ("bins", "annotated", "rows", "centroids"))
def assembled_feature_table(spark, sf_dir):
    return _rounded(_assembled(spark, sf_dir))


@query(
    _FEATURES + "SELECT * FROM assembled WHERE kept ORDER BY abs(length_controlled_logit_coef) DESC",
    ("bins", "annotated", "rows", "centroids"),
)
def retained_feature_report(spark, sf_dir):
    return _rounded(fidelity.retained_report(_assembled(spark, sf_dir)))


@query(
    """SELECT t.row_id, t.concept, coalesce(a.annotation, 0)::INTEGER AS annotation
       FROM annotated t LEFT JOIN (SELECT annotated.* FROM annotated JOIN prefs USING (row_id) WHERE label IN (0, 1)) a
       USING (row_id, concept)""",
    ("annotated",),
)
def annotation_matrix_with_gaps(spark, sf_dir):
    prefs = derived.measured(spark, sf_dir)
    known = annotations(prefs.filter(stats.is_binary_label(F.col("label"))))
    tasks = annotations(prefs).select("text_key", "concept_key")
    names = F.when(F.col("concept_key") == F.sha2(F.lit(CONCEPTS[0]), 256), CONCEPTS[0]).otherwise(CONCEPTS[1])
    return fidelity.annotated_or_zero(tasks, known).select(
        F.col("text_key").cast("long").alias("row_id"), names.alias("concept"), "annotation"
    )
