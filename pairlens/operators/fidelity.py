"""How well feature descriptions, as annotated, agree with feature activations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.special import pearson_p_value
from pairlens.operators.stats import pearson


def scored_pairs(samples: DataFrame, annotations: DataFrame, interpretations: DataFrame) -> DataFrame:
    """Sampled examples joined to the annotation of each description of their neuron.

    ``samples``: (neuron_idx, text_key, act, is_positive), a fixed number per neuron;
    ``interpretations``: (neuron_idx, interpretation); ``annotations``: (concept_key, text_key,
    annotation). Examples without an annotation drop out.
    """
    concepts = interpretations.select(
        "neuron_idx", "interpretation", F.sha2("interpretation", 256).alias("concept_key")
    ).distinct()
    return samples.join(concepts, "neuron_idx").join(
        annotations.select("concept_key", "text_key", "annotation"), ["concept_key", "text_key"]
    )


def annotated_or_zero(tasks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(text_key, concept_key, annotation) for every task, 0 where none was obtained."""
    return tasks.join(
        annotations.select("concept_key", "text_key", "annotation"), ["concept_key", "text_key"], "left"
    ).select("text_key", "concept_key", F.coalesce("annotation", F.lit(0)).alias("annotation"))


def correlation_metrics(pairs: DataFrame) -> DataFrame:
    """Per (neuron_idx, interpretation): correlation, n, recall, precision and f1.

    Constant annotations give correlation 0; constant activations leave it NaN. The last three
    need annotations in {0, 1} and both classes present, else they are 0. "precision" is one
    minus the rate among negatives.
    """
    positive = F.avg(F.when(F.col("is_positive") == 1, F.col("annotation")).cast("double"))
    negative = F.avg(F.when(F.col("is_positive") == 0, F.col("annotation")).cast("double"))
    stats = pairs.groupBy("neuron_idx", "interpretation").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("annotation") == F.max("annotation")).alias("_constant"),
        pearson(F.col("act"), F.col("annotation")).alias("_r"),
        (F.min("annotation") >= 0).alias("_binary"),
        positive.alias("_recall"),
        (1.0 - negative).alias("_precision"),
    )
    usable = F.col("_binary") & F.col("_recall").isNotNull() & F.col("_precision").isNotNull()
    both = F.col("_recall") + F.col("_precision")
    zero = F.lit(0.0)
    return stats.select(
        "neuron_idx",
        "interpretation",
        F.when(F.col("_constant"), zero)
        .otherwise(F.coalesce("_r", F.lit(float("nan"))))
        .alias("correlation"),
        F.when(F.col("_constant"), F.lit(None)).otherwise(F.col("n")).alias("n"),
        F.when(usable, F.col("_recall")).otherwise(zero).alias("recall"),
        F.when(usable, F.col("_precision")).otherwise(zero).alias("precision"),
        F.when(usable & (both > 0), 2 * F.col("_recall") * F.col("_precision") / both)
        .otherwise(zero)
        .alias("f1"),
    )


def fidelity(samples: DataFrame, annotations: DataFrame, interpretations: DataFrame) -> DataFrame:
    """Metrics of every description, also of those without a single annotation."""
    metrics = correlation_metrics(scored_pairs(samples, annotations, interpretations))
    metrics = metrics.withColumn(
        "p_value",
        F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(pearson_p_value(F.col("correlation"), F.col("n"))),
    )
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("correlation", "recall", "precision", "f1")}
    candidates = interpretations.groupBy("neuron_idx", "interpretation").agg(
        F.min("candidate_idx").alias("candidate_idx")
    )
    return (
        candidates.join(metrics.drop("n"), ["neuron_idx", "interpretation"], "left")
        .withColumns({**zero, "p_value": F.coalesce("p_value", F.lit(1.0))})
        .select(
            "neuron_idx", "candidate_idx", "interpretation",
            "correlation", "p_value", "recall", "precision", "f1",
        )
    )


def best_candidates(metrics: DataFrame) -> DataFrame:
    """The description with the highest correlation per neuron; the earliest wins ties."""
    rank = F.struct(
        F.when(F.isnan("correlation"), F.lit(float("-inf"))).otherwise(F.col("correlation")),
        -F.col("candidate_idx"),
    )
    return (
        metrics.groupBy("neuron_idx")
        .agg(F.max_by(F.struct("interpretation", "correlation", "p_value"), rank).alias("best"))
        .select("neuron_idx", "best.*")
    )


def faithful(best: DataFrame, min_correlation: float = 0.0, p_threshold: float | None = 0.05 / 32) -> DataFrame:
    """Neurons whose best description correlates enough and significantly."""
    keep = ~F.isnan("correlation") & (F.col("correlation") >= min_correlation)
    if p_threshold is not None:
        keep = keep & F.coalesce(
            ~F.isnan("p_value") & (F.col("p_value") <= p_threshold), F.lit(False)
        )
    return best.filter(keep)


def mean_abs_correlation(best: DataFrame) -> DataFrame:
    return best.agg(
        F.avg(F.abs(F.when(~F.isnan("correlation"), F.col("correlation")))).alias("mean_abs_correlation")
    )


def retained_report(features: DataFrame, signed: bool = False) -> DataFrame:
    """Kept features with known correlation and p-value, strongest label coefficient first."""
    coef = "length_controlled_logit_coef"
    known = features.filter(
        F.col("kept") & F.col("correlation").isNotNull() & F.col("p_value").isNotNull()
        & ~F.isnan("correlation") & ~F.isnan("p_value")
    )
    strength = F.col(coef) if signed else F.abs(F.col(coef))
    return known.orderBy(strength.desc_nulls_last(), "neuron_idx").withColumn(
        coef, F.coalesce(coef, F.lit(0.0))
    )
