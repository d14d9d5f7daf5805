"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the copies its source needs on average, target / size of the source: a
whole part and a probability of one copy more. Documents of a source then meet in pairs. A pair
moves words of expected mass from one to the other, in a random direction whose odds keep every
probability what it was, until one of the two is 0 or 1. The pair's expected words never change, so
the words taken by a source differ from its target by less than one document.

The work is a reduction tree: chunks of about ``chunk_rows`` documents of a source each settle all
their documents but one, ``fan`` of these residual documents settle all but one, and so on; the
last one of a source is rounded by its probability. Chunks and draws depend on the seed, the
source's rank and hashes of ids and texts, so reruns agree under any partitioning.

Defined results: a null text has size 0; documents of size 0 take no part in pairs and are taken
as often as the whole part says; a null source is a source and ranks last; a source without words
has target 0; repeated rows are documents of their own; tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import KEY, OWN, n_words, with_key

RANK, CHUNK, P, EXTRA = OWN + "rank", OWN + "chunk", OWN + "p", OWN + "extra"
SIZE, SOURCE, WHOLE, NODE = OWN + "size", OWN + "source", OWN + "whole", OWN + "node"


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0
) -> DataFrame:
    """One row per source of ``sizes`` (source, size): rank, rows, source_size and target.

    The targets fill up evenly by weight to ``share`` of all words; a source is full at ``ceiling``
    times its size. Sources in ascending order of ceiling / weight fill up one after the other, so
    prefix sums over one row per source say which are full and the level of the others.
    """
    by_name = Window.orderBy(F.col(SOURCE).asc_nulls_last())
    repeating = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sizes.groupBy(SOURCE)
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum(SIZE).cast("long").alias("source_size"))
        .withColumn(RANK, F.row_number().over(by_name) - 1)
        .withColumn("_w", F.element_at(repeating, F.pmod(F.col(RANK), F.lit(len(weights))) + 1))
        .withColumn("_cap", F.col("source_size") * float(ceiling))
    )
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), RANK)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * float(share)
    full = (
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
        + F.col("_cap") / F.col("_w") * F.sum("_w").over(onward)
        <= F.col("_total")
    )
    level = (F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))) / F.sum(
        F.when(~F.col("_full"), F.col("_w"))
    ).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    return (
        sources.withColumn("_total", total)
        .withColumn("_full", full)
        .withColumn("_level", level)
        .select(SOURCE, RANK, "_rows", "source_size", target.alias("target"))
    )


def settle(p: Sequence[float], size: Sequence[float], rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round all probabilities but at most one; also the position of that one, or -1.

    Documents meet in the order given. ``size`` must be positive.
    """
    out = np.array(p, dtype=float)
    draws = rng.random(len(out))
    held = -1
    for j in range(len(out)):
        if not 0.0 < out[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, words_i, words_j = held, size[held], size[j]
        up = min((1.0 - out[i]) * words_i, out[j] * words_j)
        down = min(out[i] * words_i, (1.0 - out[j]) * words_j)
        if draws[j] * (up + down) < down:
            moved, to_one, to_zero = up, i, j
        else:
            moved, to_one, to_zero = down, j, i
        # The one that bounds the move becomes whole exactly, free of rounding errors.
        room, mass = (1.0 - out[to_one]) * size[to_one], out[to_zero] * size[to_zero]
        out[to_one] = 1.0 if room <= mass else out[to_one] + moved / size[to_one]
        out[to_zero] = 0.0 if mass <= room else out[to_zero] - moved / size[to_zero]
        fractional = [k for k in (i, j) if 0.0 < out[k] < 1.0]
        held = fractional[0] if fractional else -1
    return out, held


def _settled_groups(rows: DataFrame, by: list[str], level: int, seed: int) -> DataFrame:
    """Settle each group; the column of extra copies stays null for its residual document."""
    schema = rows.withColumn(EXTRA, F.lit(None).cast("int")).schema

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([SIZE, *KEY], ascending=[False, True, True], kind="stable")
        marks = [int(group[c].iloc[0]) for c in by]
        rng = np.random.default_rng([seed, level, *marks])
        p, held = settle(group[P].to_numpy(float), group[SIZE].to_numpy(float), rng)
        extra = pd.array(np.round(p).astype(np.int32), dtype="Int32")
        if held >= 0:
            extra[held] = pd.NA
        return group.assign(**{P: p, EXTRA: extra})

    return rows.groupBy(*by).applyInPandas(one, schema)


def mix_documents(
    docs: DataFrame,
    size: Column | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    chunk_rows: int = 4096,
    fan: int = 64,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: key, id, size, source_size, target and copies."""
    narrow = cut_lineage(
        with_key(docs.select(id, text, source), id, text).select(
            *KEY, id, F.col(source).alias(SOURCE), (n_words(F.col(text)) if size is None else size).alias(SIZE)
        )
    )
    targets = cut_lineage(source_targets(narrow, weights, share, ceiling))
    chunks = F.ceil(F.col("_rows") / chunk_rows)
    t = targets.withColumnRenamed(SOURCE, "_name")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = (
        narrow.join(t, F.col(SOURCE).eqNullSafe(F.col("_name")))
        .withColumn("_each", each)
        .select(
            *KEY, id, SIZE, RANK, "source_size", "target",
            F.floor("_each").cast("int").alias(WHOLE),
            F.when(F.col(SIZE) > 0, F.col("_each") - F.floor("_each")).otherwise(F.lit(0.0)).alias(P),
            F.pmod(F.xxhash64(F.lit(seed), *KEY), chunks).alias(CHUNK),
        )
    )
    open_, never = F.col(P) > 0, F.lit(0).alias(EXTRA)
    first = cut_lineage(_settled_groups(placed.filter(open_), [RANK, CHUNK], 0, seed))
    done = [placed.filter(~open_).select("*", never), first.filter(F.col(EXTRA).isNotNull())]
    residual = first.filter(F.col(EXTRA).isNull()).drop(EXTRA).withColumn(NODE, F.col(CHUNK))
    most = targets.agg(F.max(chunks)).first()[0] or 0
    level = 1
    while most > 1:
        up = residual.withColumn(NODE, F.floor(F.col(NODE) / fan))
        step = cut_lineage(_settled_groups(up, [RANK, NODE], level, seed))
        done.append(step.filter(F.col(EXTRA).isNotNull()).drop(NODE))
        residual = step.filter(F.col(EXTRA).isNull()).drop(EXTRA)
        most, level = -(-most // fan), level + 1
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), RANK), F.lit(1 << 30)) / float(1 << 30)
    done.append(residual.drop(NODE).withColumn(EXTRA, (draw < F.col(P)).cast("int")))
    rows = done[0]
    for other in done[1:]:
        rows = rows.unionByName(other)
    return rows.select(
        *KEY, id, F.col(SIZE).alias("size"), "source_size", "target",
        (F.col(WHOLE) + F.col(EXTRA)).alias("copies"),
    )


def mixed_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Copies join by key. Repeated rows share a key; all their copies are taken from one of them.
    """
    rows = F.count(F.lit(1)).alias(NODE)
    copies = cut_lineage(
        mix_documents(docs, id=id, text=text, **options)
        .groupBy(*KEY)
        .agg(F.sum("copies").cast("int").alias(EXTRA), rows)
        .filter(F.col(EXTRA) > 0)
    )

    def taken(keyed: DataFrame, some: DataFrame) -> DataFrame:
        joined = keyed.join(some.drop(NODE), KEY)
        return joined.withColumn(NODE, F.explode(F.sequence(F.lit(1), F.col(EXTRA)))).drop(*KEY, EXTRA, NODE)

    keyed = with_key(docs, id, text)
    repeated = copies.filter(F.col(NODE) > 1)
    if repeated.isEmpty():
        return taken(keyed, copies)
    single = taken(keyed, copies.filter(F.col(NODE) == 1))
    once = keyed.join(repeated.select(*KEY), KEY, "left_semi").dropDuplicates(KEY)
    return single.unionByName(taken(once, repeated))
