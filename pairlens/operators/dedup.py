"""Deduplication of texts and of compared pairs, and sign augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.text import is_valid_text, text_key
from pairlens.functions.vectors import negate


def unique_texts(df: DataFrame, *texts: Column, valid_only: bool = True) -> DataFrame:
    """Distinct texts over several columns as (text_key, text).

    Repeats are dropped before the shuffle already, so a text that fills a third of the table
    costs one row per task.
    """
    long = df.select(F.explode(F.array(*texts)).alias("text"))
    if valid_only:
        long = long.filter(is_valid_text(F.col("text")))
    return long.distinct().select(text_key(F.col("text")).alias("text_key"), "text")


def seeded_hash(seed: int | Column, *parts: Column) -> Column:
    """Reproducible sampling order: md5 over the seed and the parts, joined by '|'."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first, *[p.cast("string") for p in parts]))


def seeded_rank(seed: int | Column, *parts: Column) -> Column:
    """The leading 60 bits of :func:`seeded_hash` as a long, cheap to sort and to aggregate."""
    return F.conv(F.substring(seeded_hash(seed, *parts), 1, 15), 16, 10).cast("long")


def dedup_unordered_pairs(
    df: DataFrame,
    a: str = "response_A",
    b: str = "response_B",
    seed: int = 42,
    id: str = "row_id",
    within: list[str] | None = None,
) -> DataFrame:
    """One row per unordered pair of responses (per group of ``within``), by seeded hash.

    The winner per pair is found on ids alone with a map-side combined aggregate.
    """
    groups = within or []
    pair_key = F.sha2(
        F.concat(text_key(F.least(a, b)), text_key(F.greatest(a, b))), 256
    )
    winners = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(*groups, pair_key.alias("_pair"), id)
        .groupBy(*groups, "_pair")
        .agg(F.min_by(F.col(id), seeded_rank(seed, F.col(id))).alias(id))
        .select(id)
    )
    return df.join(winners, id, "left_semi")


def merge_duplicate_labels(
    df: DataFrame,
    prompt: str = "prompt",
    a: str = "response_A",
    b: str = "response_B",
    label: str = "label",
    id: str = "row_id",
) -> DataFrame:
    """One row per (prompt, A, B): label = mean rounded half to even, first id and length_delta.

    Groups with a null key are left out, and so is a group without any label.
    """
    keyed = df.filter(
        F.col(prompt).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    ).select(
        F.sha2(F.concat(text_key(F.col(prompt)), text_key(F.col(a)), text_key(F.col(b))), 256).alias("_k"),
        id,
        F.col(label).cast("double").alias("_label"),
        F.col("length_delta").alias("_delta"),
    )
    merged = (
        keyed.groupBy("_k")
        .agg(
            F.bround(F.avg("_label"), 0).cast("int").alias(label),
            F.min_by(
                F.col("_delta"), F.when(F.col("_delta").isNotNull(), F.col(id))
            ).alias("length_delta"),
            F.min(id).alias(id),
        )
        .filter(F.col(label).isNotNull())
        .select(id, label, "length_delta")
    )
    texts = df.select(id, prompt, a, b)
    return texts.join(merged, id).select(id, prompt, a, b, label, "length_delta")


def augment_signs(deltas: DataFrame, vector: str = "delta") -> DataFrame:
    """Every difference and its negation, told apart by ``sign``."""
    signed = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    both = deltas.select("*", signed)
    return both.withColumn(
        vector, F.when(F.col("sign") == 1, F.col(vector)).otherwise(negate(F.col(vector)))
    )
