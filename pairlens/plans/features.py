"""The full job: encoder, descriptions, their fidelity, label coefficients, feature table."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import (
    EncoderConfig, InterpretationConfig, JobConfig, RuntimeConfig, SelectionConfig, DatasetConfig, for_debug,
)
from pairlens.functions.text import text_key
from pairlens.lineage import cut_lineage
from pairlens.operators.activations import firing_rates
from pairlens.operators.annotate import annotate
from pairlens.operators.completion import Completer, Completers, Embedder, configured
from pairlens.operators.dedup import augment_signs
from pairlens.operators.embed import embed_texts
from pairlens.operators.encoder import (
    EncoderParams, checkpoint_name, encode, load_params, params_exist, reconstruction_loss, save_params,
)
from pairlens.operators.encoder_fit import fit_encoder
from pairlens.operators.fidelity import best_candidates, faithful, fidelity, mean_abs_correlation
from pairlens.operators.interpret import Sampler, abbreviate, interpret, strongest_rows
from pairlens.operators.linear import controlled_coefs, lasso_search
from pairlens.operators.probe import ProbeTask, fit_probes
from pairlens.operators.redundancy import redundancy
from pairlens.operators.sampling import sample_percentile_bins
from pairlens.operators.stats import pearson, roc_auc
from pairlens.plans.preprocess import (
    Embedded, Preprocessed, embed_responses, in_subset, load_and_preprocess, preprocess, sampled_pair_texts,
)
from pairlens.sources.steps import Steps, fingerprint, named, table_fingerprint

SIMILARITY_THRESHOLD = 0.7


def train_encoder(
    spark: SparkSession, dedup_train: DataFrame, dedup_val: DataFrame | None, cfg: EncoderConfig,
    runtime: RuntimeConfig, n_partitions: int | None = None, step: str | None = None,
) -> EncoderParams:
    """Fit on the sign-augmented deltas, or reuse the stored model: the one of the same shape in the
    checkpoint folder, or else the one of an earlier run of the same job (``step``)."""
    path = step
    if runtime.checkpoint_dir:
        path = os.path.join(runtime.checkpoint_dir, checkpoint_name(cfg.M, cfg.K, cfg.prefix_lengths))
    if path and not runtime.retrain_sae and params_exist(spark, path):
        return load_params(spark, path)
    params, _ = fit_encoder(augment_signs(dedup_train), dedup_val, cfg.fit_config(), n_partitions)
    if path:
        save_params(spark, params, path)
    return params


def bins_by_config(acts: DataFrame, cfg: InterpretationConfig) -> DataFrame:
    """Scoring samples: random rows of a high and a low bin of each neuron's activations."""
    kw = cfg.scoring_sampling_kwargs
    low = kw.get("low_percentile")
    return sample_percentile_bins(
        acts,
        cfg.scoring_n_examples,
        tuple(kw.get("high_percentile", (90, 100))),
        tuple(low) if low is not None else None,
        kw.get("nonzero_only", True),
        seed="neuron_idx",
    )


@dataclass(frozen=True)
class Hooks:
    """What a job may be given in place of its own samplers and its rendering of a pair.

    ``interpret_sampler`` returns (neuron_idx, candidate_idx, row_id, act), ``scoring_sampler``
    (neuron_idx, row_id, act, is_positive), and ``texts`` the (row_id, text) of sampled rows.
    """

    interpret_sampler: Sampler = strongest_rows
    scoring_sampler: Callable[[DataFrame, InterpretationConfig], DataFrame] = bins_by_config
    texts: Callable[[DataFrame, DataFrame, DatasetConfig], DataFrame] = sampled_pair_texts


def interpret_features(
    rows: DataFrame, acts_dedup: DataFrame, dataset: DatasetConfig, cfg: InterpretationConfig,
    completer: Completer, concurrency: int | None = None, hooks: Hooks = Hooks(),
) -> DataFrame:
    """(neuron_idx, candidate_idx, interpretation) from samples of ``acts_dedup``."""

    def texts_for(samples: DataFrame) -> DataFrame:
        return hooks.texts(rows, samples, dataset)

    return interpret(
        acts_dedup, texts_for, cfg.interpret_config(), completer, concurrency, sampler=hooks.interpret_sampler,
        timeout=cfg.timeout,
    )


@dataclass
class Scores:
    metrics: DataFrame  # every description
    best: DataFrame  # the best one per neuron
    kept: DataFrame  # those that pass the fidelity filter


def score_features(
    interpretations: DataFrame, rows: DataFrame, acts_train: DataFrame, dataset: DatasetConfig,
    cfg: InterpretationConfig, completer: Completer, cache_path: str | None = None,
    concurrency: int | None = None, hooks: Hooks = Hooks(),
) -> Scores:
    """Annotate sampled pairs with every description and keep the faithful ones."""
    described = interpretations.select("neuron_idx").distinct()
    samples = cut_lineage(hooks.scoring_sampler(acts_train, cfg).join(described, "neuron_idx", "left_semi"))
    texts = hooks.texts(rows, samples, dataset)
    samples = cut_lineage(
        samples.join(texts, "row_id").withColumn("text_key", text_key(F.col("text")))
    )
    tasks = samples.select("neuron_idx", "text_key", "text").join(
        interpretations.select(
            "neuron_idx", F.col("interpretation").alias("concept"), F.sha2("interpretation", 256).alias("concept_key")
        ),
        "neuron_idx",
    ).drop("neuron_idx")
    annotations = annotate(
        tasks, completer, cfg.annotator_model, cache_path=cache_path, concurrency=concurrency, timeout=cfg.timeout
    )
    metrics = cut_lineage(fidelity(samples, annotations, interpretations))
    best = best_candidates(metrics)
    return Scores(metrics, best, faithful(best, cfg.min_correlation, cfg.p_value_threshold))


def prediction_rows(acts: DataFrame, subset: str, controls: list[str]) -> DataFrame:
    """Binary-label rows of a split, narrowed to what the models read."""
    numbers = [F.col(c).cast("double").alias(c) for c in controls]
    return acts.filter(in_subset(subset)).select("row_id", "label", *numbers, "acts")


def feature_coefs(train_rows: DataFrame, cfg: SelectionConfig) -> DataFrame:
    """(neuron_idx, coef): each feature's label coefficient next to the controls."""
    return controlled_coefs(
        train_rows, cfg.controls, classification=cfg.classification, standardize=cfg.standardize
    )


def _picked(neurons: list[int]) -> Column:
    return F.array(*[F.col("acts")[i] for i in neurons])


@dataclass
class Selections:
    aucs: DataFrame  # (metric, value)
    coefs: DataFrame  # (top_k, neuron_idx, coef)


COEFS = "top_k int, neuron_idx int, coef double"


def selection_sizes(wanted: list[int], n_kept: int) -> list[int]:
    """The wanted sizes in ascending order, with the number of kept features where it is smaller
    than the largest of them, or where none is wanted."""
    sizes = set(wanted)
    if not sizes or n_kept < max(sizes):
        sizes.add(n_kept)
    return sorted(sizes)


def select_and_probe(train: DataFrame, val: DataFrame, kept: list[int], cfg: SelectionConfig) -> Selections:
    """For each size: pick features by controlled L1, refit a probe; then probe all features.

    All probes are fitted in the same passes, and ranked in one pass over their scores.
    """
    spark = train.sparkSession
    train, val = train.persist(), val.persist()
    tasks, coefs = [], []
    if cfg.use_lasso and kept:
        kept_rows = train.withColumn("acts", _picked(kept))
        with lasso_search(
            kept_rows, cfg.controls, classification=cfg.classification,
            max_samples=cfg.max_samples_lasso, standardize=cfg.standardize,
        ) as path:
            for size in selection_sizes(cfg.lasso_top_k, len(kept)):
                try:
                    chosen = path.select(min(size, len(kept)))
                except ValueError:
                    continue
                neurons = [kept[i] for i in chosen.neurons]
                coefs += [(size, n, c) for n, c in zip(neurons, chosen.coefs)]
                tasks.append(ProbeTask(f"lasso_top_{size}", neurons))
    tasks.append(ProbeTask("full_sae"))
    probes = fit_probes(train, tasks, cfg.controls, classification=cfg.classification)
    sides = [probes.scores(df).withColumn("split", F.lit(split)) for df, split in ((train, "train"), (val, "val"))]
    together = sides[0].unionByName(sides[1])
    by = ("probe", "split")
    if cfg.classification:
        values = roc_auc(together, "label", "score", by).withColumnRenamed("auc", "value")
    else:
        values = together.groupBy(*by).agg(pearson(F.col("label"), F.col("score")).alias("value"))
    aucs = cut_lineage(values.select(F.concat("probe", F.lit("_"), "split", F.lit("_auc")).alias("metric"), "value"))
    train.unpersist(), val.unpersist()
    return Selections(aucs, spark.createDataFrame(coefs, COEFS))


def feature_table(
    n_neurons: int, best: DataFrame, kept: DataFrame, abbreviations: DataFrame, rates: DataFrame,
    closeness: DataFrame, coefs: DataFrame,
) -> DataFrame:
    """One row per neuron, described or not, joined on the neuron index throughout."""
    neurons = best.sparkSession.range(n_neurons).select(F.col("id").cast("int").alias("neuron_idx"))
    return (
        neurons.join(best, "neuron_idx", "left")
        .join(abbreviations.select("neuron_idx", "abbreviated_interpretation"), "neuron_idx", "left")
        .join(rates.select("neuron_idx", "prevalence"), "neuron_idx", "left")
        .join(kept.select("neuron_idx", F.lit(True).alias("_kept")), "neuron_idx", "left")
        .join(closeness.withColumn("neuron_idx", F.col("id").cast("int")).drop("id"), "neuron_idx", "left")
        .join(coefs.select("neuron_idx", F.col("coef").alias("length_controlled_logit_coef")), "neuron_idx", "left")
        .select(
            "neuron_idx", "interpretation",
            F.coalesce("abbreviated_interpretation", F.lit("")).alias("abbreviated_interpretation"),
            "prevalence", "correlation", "p_value", F.col("_kept").isNotNull().alias("kept"),
            "semantic_redundancy", "semantic_neighbor", "length_controlled_logit_coef",
        )
    )


@dataclass
class JobResult:
    params: EncoderParams
    data: Preprocessed
    embedded: Embedded
    activations: DataFrame  # (row_id, label, controls..., split, binary, dedup, acts) of every row
    interpretations: DataFrame
    scores: Scores
    features: DataFrame
    selections: Selections
    summary: DataFrame  # (metric, value)
    kept_neurons: list[int] = field(default_factory=list)


SUMMARY = "metric string, value double"


def run_job(
    spark: SparkSession, cfg: JobConfig, embedder: Embedder, completer: Completer | Completers,
    df: DataFrame | None = None, n_partitions: int | None = None, hooks: Hooks = Hooks(),
) -> JobResult:
    """Everything from the preference table (or ``df``) to the feature table.

    ``completer`` serves all roles, or is one service for each (``Completers``).

    Results that later steps share, and all answers that cost money, are checkpointed or
    cached; the rest stays lazy. With a cache folder a job that failed goes on where it stopped:
    vectors, the encoder, activations, descriptions, annotations and short forms are kept there under
    fingerprints of the input and of the configuration they follow from. Model names tell services
    apart; what a hook does is known by its name only.
    """
    runtime, asked = cfg.runtime, cfg.interpretation
    ask = Completers.of(completer)
    limits = {"max_tokens": asked.max_interpretation_tokens}
    ask = Completers(
        configured(ask.interpreter, model=asked.interpreter_model, **limits, **asked.completion_kwargs),
        configured(ask.annotator, model=asked.annotator_model, **asked.completion_kwargs),
        configured(ask.abbreviator, model=asked.abbreviator_model, **asked.completion_kwargs),
    )
    if runtime.debug:
        cfg = for_debug(cfg)
    controls = tuple(cfg.selection.controls)
    data = (
        load_and_preprocess(spark, cfg.dataset, runtime, controls)
        if df is None
        else preprocess(df, cfg.dataset, runtime.debug, controls)
    )

    def cache(name: str) -> str | None:
        return os.path.join(runtime.cache_dir, name) if runtime.cache_dir else None

    cores = spark.sparkContext.defaultParallelism
    steps = Steps(spark, cache("steps"))
    source = ""
    if steps.folder:
        source = table_fingerprint(data.rows, ["row_id", "prompt", "response_A", "response_B", "label", *dict.fromkeys(controls)])
    made_from = fingerprint(source, asdict(cfg.dataset), asdict(cfg.embedding), asdict(cfg.sae), runtime.debug)
    workers = cfg.embedding.n_workers
    emb = embed_responses(data, embedder, cfg.embedding.model, cache("embeddings"), workers)
    params = train_encoder(
        spark, emb.of("dedup_train"), emb.of("dedup_val"), cfg.sae, runtime, n_partitions, steps.path("encoder", made_from)
    )
    model = hashlib.sha256(b"".join(np.ascontiguousarray(x).tobytes() for x in (params.enc, params.dec, params.input_bias, params.neuron_bias))).hexdigest()
    acts_of = fingerprint(made_from, model, params.threshold)
    acts = steps.table("activations", acts_of, lambda: encode(emb.deltas, params, keep=emb.riders))
    acts_train = acts.filter(in_subset("train"))
    loss = reconstruction_loss(emb.deltas, params)

    icfg = cfg.interpretation
    described = fingerprint(acts_of, asdict(icfg.interpret_config()), icfg.interpreter_model, limits, icfg.completion_kwargs,
                            named(hooks.interpret_sampler), named(hooks.texts))
    interpretations = steps.table(
        "interpretations", described,
        lambda: interpret_features(
            data.rows, acts.filter(in_subset("dedup_train")), cfg.dataset, icfg, ask.interpreter,
            min(icfg.n_workers_interpretation, cores), hooks,
        ),
    )
    scores = score_features(
        interpretations, data.rows, acts_train, cfg.dataset, icfg, ask.annotator, cache("annotations"),
        min(icfg.n_workers_annotation, cores), hooks,
    )
    best = cut_lineage(scores.best)
    told = table_fingerprint(best, ["neuron_idx", "interpretation"]) if steps.folder else ""
    short = steps.table(
        "abbreviations", fingerprint(told, icfg.abbreviator_model, icfg.completion_kwargs),
        lambda: abbreviate(best, ask.abbreviator, timeout=icfg.timeout),
    )
    concepts = best.select(
        F.col("neuron_idx").alias("id"), F.col("interpretation").alias("text"), text_key(F.col("interpretation")).alias("text_key")
    )
    vectors = embed_texts(concepts.select("text_key", "text").distinct(), embedder, cfg.embedding.model, cache("embeddings"), concurrency=workers)
    closeness, n_components = redundancy(
        cut_lineage(concepts.join(vectors, "text_key").select("id", "text", "embedding")), SIMILARITY_THRESHOLD
    )

    train_rows, val_rows = (
        prediction_rows(acts, subset, cfg.selection.controls) for subset in ("train_pred", "val_pred")
    )
    coefs = feature_coefs(train_rows, cfg.selection)
    # At most one number per neuron of the model.
    kept = sorted(r.neuron_idx for r in scores.kept.select("neuron_idx").collect())
    selections = select_and_probe(train_rows, val_rows, kept, cfg.selection)
    features = feature_table(
        params.n_neurons, best, scores.kept, short, firing_rates(acts_train), closeness, coefs
    )
    mean_r = mean_abs_correlation(best).first()[0]
    summary = [
        ("quality/mean_abs_fidelity_correlation", float("nan") if mean_r is None else mean_r),
        ("quality/num_semantic_components", float(n_components)),
        ("quality/num_neurons_total", float(params.n_neurons)),
        ("quality/num_neurons_kept", float(len(kept))),
        ("sae/reconstruction_norm_mse_train_val", loss.first()[0]),
        # Pairs that take no part because a response has no vector.
        ("data/num_pairs_without_vector", float(data.members.count() - emb.deltas.count())),
    ]
    return JobResult(
        params, data, emb, acts, interpretations, scores,
        cut_lineage(features), selections, spark.createDataFrame(summary, SUMMARY), kept,
    )
