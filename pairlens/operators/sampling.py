"""Example sampling for all neurons at once.

Activations come as ``acts`` (id, acts array). Random choices follow the seeded hash of (seed,
neuron, row), so they are reproducible on any cluster. Nothing is grouped whole: quantiles come
from bracketed order statistics and each neuron's sample is thinned in salted pieces first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.activations import long_activations
from pairlens.operators.dedup import seeded_rank
from pairlens.operators.ordered import exact_quantiles, top_n_per_group

Seed = int | str


def _seed_column(seed: Seed) -> Column:
    """A number, or the name of a column holding the seed (e.g. ``neuron_idx``)."""
    return F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))


def _random_order(seed: Seed, id: str) -> list[Column]:
    return [seeded_rank(_seed_column(seed), F.col("neuron_idx"), F.col(id)), F.col(id)]


def sample_top_zero(acts: DataFrame, n: int, seed: Seed = 0, id: str = "row_id") -> DataFrame:
    """Largest signed activations as positives, random silent rows as negatives.

    Returns (neuron_idx, id, act, is_positive) with at most n // 2 (but one) rows per class.
    """
    half = max(n // 2, 1)
    long = long_activations(acts, id, nonzero=False)
    top = top_n_per_group(long, ["neuron_idx"], [F.col("act").desc(), F.col(id)], half, id)
    zeros = top_n_per_group(long.filter("act = 0"), ["neuron_idx"], _random_order(seed, id), half, id)
    return _labelled(top, zeros, id)


def _labelled(positives: DataFrame, negatives: DataFrame, id: str) -> DataFrame:
    columns = ["neuron_idx", id, "act"]
    return (
        positives.select(*columns, F.lit(1).alias("is_positive"))
        .unionByName(negatives.select(*columns, F.lit(0).alias("is_positive")))
    )


def sample_percentile_bins(
    acts: DataFrame,
    n: int,
    high: tuple[float, float] = (90, 100),
    low: tuple[float, float] | None = None,
    nonzero_only: bool = True,
    seed: Seed = "neuron_idx",
    id: str = "row_id",
) -> DataFrame:
    """Random positives from the high bin and negatives from the low bin of signed activations.

    Bins are closed, so a value on a shared bound may serve both classes. Without a low bin
    negatives are silent rows (``nonzero_only``) or any rows. A neuron that never fires yields
    nothing under ``nonzero_only``.
    """
    half = max(n // 2, 1)
    base = long_activations(acts, id, nonzero=nonzero_only)
    bins = [high] if low is None else [high, low]
    cuts = exact_quantiles(base, ["neuron_idx"], "act", [p / 100.0 for b in bins for p in b])
    # At most one row per neuron of the model.
    bounded = base.join(F.broadcast(cuts.drop("n")), "neuron_idx")
    order = _random_order(seed, id)

    def in_bin(i: int) -> DataFrame:
        lo, hi = F.element_at("q", 2 * i + 1), F.element_at("q", 2 * i + 2)
        inside = bounded.filter(F.col("act").between(lo, hi))
        return top_n_per_group(inside, ["neuron_idx"], order, half, id)

    if low is not None:
        negatives = in_bin(1)
    else:
        others = long_activations(acts, id, nonzero=False)
        if nonzero_only:
            others = others.filter("act = 0").join(
                F.broadcast(cuts.select("neuron_idx")), "neuron_idx", "left_semi"
            )
        negatives = top_n_per_group(others, ["neuron_idx"], order, half, id)
    return _labelled(in_bin(0), negatives, id)


def sample_top_only(
    acts: DataFrame,
    n: int,
    percentile_bin: tuple[float, float] | None = None,
    n_top: int | None = None,
    nonzero_only: bool = True,
    seed: Seed = 0,
    id: str = "row_id",
    candidates: int = 1,
) -> DataFrame:
    """Random ``n`` rows per neuron and candidate among the strongest absolute activations.

    Eligible are a percentile bin of the magnitudes (all rows for a neuron that never fires),
    or the ``n_top`` strongest rows, or every row. Candidate c samples with seed + c. Returns
    (neuron_idx, candidate_idx, id, act) with signed activations.
    """
    long = long_activations(acts, id, nonzero=False).withColumn("_mag", F.abs("act"))
    if percentile_bin is not None:
        pool = long.filter("act <> 0") if nonzero_only else long
        cuts = exact_quantiles(pool, ["neuron_idx"], "_mag", [p / 100.0 for p in percentile_bin])
        neurons = long.join(F.broadcast(cuts.drop("n")), "neuron_idx", "left")
        fires = F.lit(True) if not nonzero_only else F.col("act") != 0
        inside = fires & F.col("_mag").between(F.element_at("q", 1), F.element_at("q", 2))
        eligible = neurons.filter(F.col("q").isNull() | inside).drop("q")
    elif n_top is not None:
        eligible = top_n_per_group(
            long, ["neuron_idx"], [F.col("_mag").desc(), F.col(id)], n_top, id
        )
    else:
        eligible = long
    tried = eligible.select(
        "neuron_idx", id, "act", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("candidate_idx")
    )
    base_seed = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    order = [
        seeded_rank((base_seed + F.col("candidate_idx")).cast("string"), F.col("neuron_idx"), F.col(id)),
        F.col(id),
    ]
    return top_n_per_group(tried, ["neuron_idx", "candidate_idx"], order, n, id).select(
        "neuron_idx", "candidate_idx", id, "act"
    )
