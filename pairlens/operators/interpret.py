"""Describing features in words from sampled examples, and shortening the descriptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.answers import clean_interpretation
from pairlens.functions.text import render, strip, swap_if_negative, truncate_col
from pairlens.lineage import cut_lineage
from pairlens.operators.completion import Completer, complete
from pairlens.operators.sampling import sample_top_only
from pairlens.prompts import template


@dataclass
class InterpretConfig:
    n_examples: int = 5
    n_candidates: int = 5
    percentile_bin: tuple[float, float] | None = (95, 100)
    n_top: int | None = None
    nonzero_only: bool = True
    swap_negative: bool = True
    max_words: int | None = None
    seed: int = 0
    prompt_name: str = "interpret-feature-top-pairs"


TextsFor = Callable[[DataFrame], DataFrame]
# (activations, config, id) to (neuron_idx, candidate_idx, id, act).
Sampler = Callable[[DataFrame, InterpretConfig, str], DataFrame]


def strongest_rows(acts: DataFrame, cfg: InterpretConfig, id: str) -> DataFrame:
    """The sampler unless another one is given: random rows among the strongest activations."""
    return sample_top_only(
        acts, cfg.n_examples, cfg.percentile_bin, cfg.n_top, cfg.nonzero_only, cfg.seed, id, cfg.n_candidates
    )


def interpretation_prompts(
    acts: DataFrame, texts_for: TextsFor, cfg: InterpretConfig, id: str = "row_id", sampler: Sampler = strongest_rows
) -> DataFrame:
    """(neuron_idx, candidate_idx, prompt) with ``n_examples`` rendered pairs each.

    ``texts_for(samples)`` returns (id, text) for the sampled ids; it is given the samples in a
    checkpoint, so that only these few rows of the wide table are ever rendered.
    """
    samples = cut_lineage(sampler(acts, cfg, id))
    text = swap_if_negative(F.col("text"), F.col("act")) if cfg.swap_negative else F.col("text")
    text = truncate_col(text, max_words=cfg.max_words)
    rendered = samples.join(texts_for(samples).select(id, "text"), id).select(
        "neuron_idx", "candidate_idx", F.struct(F.col(id), text.alias("text")).alias("example")
    )
    # n_examples rows per group.
    listed = rendered.groupBy("neuron_idx", "candidate_idx").agg(
        F.array_sort(F.collect_list("example")).alias("examples")
    )
    block = F.array_join(F.transform("examples", lambda e: e["text"]), "\n\n")
    return listed.select(
        "neuron_idx", "candidate_idx", render(template(cfg.prompt_name), examples=block).alias("prompt")
    )


def interpret(
    acts: DataFrame, texts_for: TextsFor, cfg: InterpretConfig, completer: Completer,
    concurrency: int | None = None, id: str = "row_id", sampler: Sampler = strongest_rows, timeout: float | None = None,
) -> DataFrame:
    """(neuron_idx, candidate_idx, interpretation); empty or failed answers are left out."""
    prompts = interpretation_prompts(acts, texts_for, cfg, id, sampler)
    keys = ["neuron_idx", "candidate_idx"]
    answers = complete(prompts, keys, completer, clean_interpretation, 1, concurrency, timeout)
    return answers.select(*keys, F.col("parsed").alias("interpretation")).filter("interpretation <> ''")


def abbreviate(
    interpretations: DataFrame, completer: Completer, column: str = "interpretation",
    out: str = "abbreviated_interpretation", concurrency: int | None = None, timeout: float | None = None,
) -> DataFrame:
    """Add a short form; blank stays '', and the text itself is used if no answer comes back."""
    concept = strip(F.col(column))
    texts = interpretations.select(concept.alias("_concept")).filter("_concept <> ''").distinct()
    prompts = texts.withColumn("prompt", render(template("abbreviate-concept"), concept=F.col("_concept")))

    def non_blank(answer):
        return F.when(strip(answer) != "", strip(answer))

    short = complete(prompts, ["_concept"], completer, non_blank, 3, concurrency, timeout)
    return (
        interpretations.withColumn("_concept", F.coalesce(concept, F.lit("")))
        .join(short, "_concept", "left")
        .withColumn(out, F.coalesce("parsed", "_concept"))
        .drop("_concept", "parsed")
    )
