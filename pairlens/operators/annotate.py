"""Annotating pairs with concepts through a completer, with a cache table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.answers import parse_multi_label, parse_pairwise, parse_yes_no
from pairlens.functions.text import render, truncate_col
from pairlens.lineage import cut_lineage
from pairlens.operators.completion import Completer, complete
from pairlens.operators.dedup import seeded_rank
from pairlens.operators.fidelity import annotated_or_zero
from pairlens.operators.joins import cached_split, text_concept_tasks, texts_to_reannotate
from pairlens.prompts import canonical, template
from pairlens.schema import ANNOTATION_CACHE
from pairlens.sources.caches import append_cache, read_cache

KEYS = ["concept_key", "text_key"]
PAIRWISE_PROMPTS = {"pairwise-annotate-singleconcept"}


def cache_key(model: str, prompt_name: str, concept: Column, text: Column) -> Column:
    """Collision-free key of one annotation."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), F.lit(prompt_name), concept, text), 256)


def annotate(
    tasks: DataFrame,
    completer: Completer,
    model: str = "offline",
    prompt_name: str = "pairwise-annotate-singleconcept",
    cache_path: str | None = None,
    max_tries: int = 3,
    concurrency: int | None = None,
    max_words: int | None = None,
    parse: Callable[[Column], Column] | None = None,
    timeout: float | None = None,
) -> DataFrame:
    """(concept_key, text_key, annotation) of (text_key, text, concept_key, concept) tasks.

    Equal tasks are asked once, cached ones not at all; unparseable answers are absent. Without
    ``parse`` the pairwise prompts expect A / B / Tie and all others yes / no.
    """
    if parse is None:
        parse = parse_pairwise if canonical(prompt_name) in PAIRWISE_PROMPTS else parse_yes_no
    wanted = tasks.dropDuplicates(KEYS)
    spark = tasks.sparkSession
    cache = read_cache(spark, cache_path, ANNOTATION_CACHE, KEYS, model=model, prompt_name=prompt_name)
    _, misses = cached_split(wanted, cache, KEYS)
    text = F.col("text") if max_words is None else truncate_col(F.col("text"), max_words=max_words)
    prompts = misses.withColumn("prompt", render(template(prompt_name), text=text, concept=F.col("concept")))
    fresh = complete(prompts, KEYS, completer, parse, max_tries, concurrency, timeout).select(
        *KEYS, F.col("parsed").alias("annotation")
    )
    return _known(cache, fresh, wanted, cache_path, model, prompt_name)


def _known(
    cache: DataFrame, fresh: DataFrame, wanted: DataFrame, cache_path: str | None, model: str, prompt_name: str
) -> DataFrame:
    """Annotations of the wanted tasks; fresh ones replace cached ones, here and for later readers."""
    if cache_path is not None:
        old = cut_lineage(cache.join(wanted.select(*KEYS), KEYS, "left_semi"))
        newer = cut_lineage(
            fresh.join(old.select(*KEYS, F.col("annotation").alias("_old")), KEYS, "left")
            .filter(F.col("_old").isNull() | (F.col("_old") != F.col("annotation")))
            .drop("_old")
        )
        if not newer.isEmpty():
            append_cache(newer, cache_path, KEYS, model=model, prompt_name=prompt_name)
        cache = old
    kept = cache.join(fresh.select(*KEYS), KEYS, "left_anti").join(
        wanted.select(*KEYS), KEYS, "left_semi"
    )
    return kept.select(*KEYS, "annotation").unionByName(fresh)


def annotate_matrix(texts: DataFrame, concepts: list[str], completer: Completer, **options) -> DataFrame:
    """Every text with every concept, 0 where no annotation was obtained.

    ``texts`` has (text_key, text); returns (text_key, concept_key, annotation).
    """
    tasks = text_concept_tasks(texts, concepts)
    return annotated_or_zero(tasks, annotate(tasks, completer, **options))


def as_columns(matrix: DataFrame, concepts: list[str]) -> DataFrame:
    """One row per text with one column ``concept_<i>`` per concept."""
    keys = {c: F.sha2(F.lit(c), 256) for c in concepts}
    return matrix.groupBy("text_key").agg(
        *[
            F.max(F.when(F.col("concept_key") == keys[c], F.col("annotation"))).alias(f"concept_{i}")
            for i, c in enumerate(concepts)
        ]
    )


def annotate_multi(
    texts: DataFrame,
    concepts: list[str],
    completer: Completer,
    model: str = "offline",
    prompt_name: str = "pairwise-annotate-multiconcept",
    cache_path: str | None = None,
    max_tries: int = 3,
    concurrency: int | None = None,
    seed: int = 42,
    timeout: float | None = None,
) -> DataFrame:
    """All concepts of a text in one call, for texts lacking any of them.

    The concepts of each call are listed in a seeded order of their own. A text whose answer
    cannot be read keeps its cached values, others are 0: (text_key, concept_key, annotation).
    """
    concepts = list(dict.fromkeys(concepts))
    spark = texts.sparkSession
    tasks = text_concept_tasks(texts.select("text_key"), concepts)
    cache = read_cache(spark, cache_path, ANNOTATION_CACHE, KEYS, model=model, prompt_name=prompt_name)
    asked = texts.join(texts_to_reannotate(tasks, cache), "text_key", "left_semi")
    ordered = F.transform(
        F.array_sort(
            F.transform(
                F.array(*[F.lit(c) for c in concepts]),
                lambda c: F.struct(seeded_rank(seed, F.col("text_key"), c).alias("r"), c.alias("concept")),
            )
        ),
        lambda s: s["concept"],
    )
    block = F.array_join(F.transform(ordered, lambda c: F.concat(F.lit("- "), c)), "\n")
    prompts = asked.withColumn(
        "prompt", render(template(prompt_name), text=F.col("text"), concepts_block=block)
    )
    n = len(concepts)
    answers = complete(
        prompts, ["text_key"], completer, lambda a: parse_multi_label(a, n), max_tries, concurrency, timeout
    )
    # The order is a function of the text key, so it can be rebuilt next to the answer.
    paired = F.explode(F.arrays_zip(ordered.alias("concept"), F.col("parsed").alias("annotation")))
    fresh = answers.select("text_key", paired.alias("p")).select(
        F.sha2(F.col("p.concept"), 256).alias("concept_key"), "text_key", F.col("p.annotation").alias("annotation")
    )
    return annotated_or_zero(tasks, _known(cache, fresh, tasks, cache_path, model, prompt_name))
