"""Exact order statistics without ever sorting one group in one task.

Everything here works in two levels: a small table of buckets per group carries the prefix
sums, and the ordering inside a bucket is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.dedup import seeded_hash

HASH_BUCKET_DIGITS = 3  # 16 ** 3 buckets of a uniform hex hash


def hash_prefix_sum(
    df: DataFrame, seed: int, id: str, size: Column, out: str = "before", total: str = "total"
) -> DataFrame:
    """Running total of ``size`` over the rows before each row in seeded hash order.

    Also adds the grand total. Buckets are hash prefixes, hence of equal size, and only their
    4096 totals meet in a single window.
    """
    order = F.col("_hash"), F.col(id)
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(id))).withColumns(
        {"_bucket": F.substring("_hash", 1, HASH_BUCKET_DIGITS), "_size": size}
    )
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        hashed.groupBy("_bucket")
        .agg(F.sum("_size").alias("_in_bucket"))
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_in_bucket").over(ahead), F.lit(0)),
                total: F.sum("_in_bucket").over(Window.partitionBy()),
            }
        )
        .drop("_in_bucket")
    )
    inside = (
        Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hashed.join(F.broadcast(buckets), "_bucket")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .drop("_hash", "_bucket", "_size", "_offset")
    )


def cap_rows(df: DataFrame, n: int = 10_000, seed: int = 42, id: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the first in seeded hash order.

    Bucket counts tell which hash prefixes are needed, so only about n rows are shuffled.
    """
    digits = 4
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(id))).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_need", n - F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
        .filter("_need > 0")
        .select("_bucket", "_need")
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", id))
    return (
        hashed.join(F.broadcast(needed), "_bucket")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= F.col("_need"))
        .drop("_hash", "_bucket", "_need", "_rank")
    )


def top_n_per_group(
    df: DataFrame, groups: list[str], order: list[Column], n: int, spread: str = "row_id", salts: int = 64
) -> DataFrame:
    """First ``n`` rows of each group; a large group is first thinned in ``salts`` pieces."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    for by in ([*groups, "_salt"], groups):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return salted.drop("_salt")


def _cell(bounds: list[Column], i: int, edge: str, accuracy: int) -> Column:
    """Bracket end i of a group: its extreme value while the group is small."""
    return F.when(F.col("_n") <= accuracy, F.col(edge)).otherwise(bounds[i])


def exact_order_statistics(
    df: DataFrame,
    groups: list[str],
    value: str,
    fractions: list[float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Neighbouring order statistics around ``fraction * (n - 1)`` for every group.

    Returns (groups..., _n, _target, low, high), one row per group and fraction, where low and
    high are the values at the floor and the ceiling of the position.

    A quantile sketch brackets each position between two values that are 4/accuracy of the
    group apart; the data is then read once more, counting what lies below a bracket and
    keeping only distinct values inside it. The sketch error is below half that margin, so the
    positions are always inside, and a check raises if that ever failed.
    """
    keys = groups or ["_all"]
    if not groups:
        df = df.withColumn("_all", F.lit(0))
    data = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    margin = 2.0 / accuracy
    probes = [max(p - margin, 0.0) for p in fractions] + [min(p + margin, 1.0) for p in fractions]
    k = len(fractions)
    sketch = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", probes, accuracy).alias("_b"),
    )
    bounds = [F.element_at("_b", i + 1) for i in range(2 * k)]
    brackets = sketch.select(
        *keys,
        "_n",
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("target"),
                    (F.lit(p) * (F.col("_n") - 1)).alias("position"),
                    (F.col("_min") if p <= margin else _cell(bounds, i, "_min", accuracy)).alias("lo"),
                    (F.col("_max") if p >= 1 - margin else _cell(bounds, k + i, "_max", accuracy)).alias("hi"),
                )
                for i, p in enumerate(fractions)
            ]
        ).alias("_targets"),
    )
    if groups:
        # One row per group: groups are features or splits of one model, not data keys.
        placed = data.join(F.broadcast(brackets), keys)
    else:
        whole = brackets.select(F.struct("_n", "_targets")).scalar()
        placed = data.withColumn("_b", whole).select(*keys, "_v", "_b._n", "_b._targets")
    hits = (
        placed.select(
            *keys,
            "_n",
            "_v",
            F.explode(F.filter("_targets", lambda t: F.col("_v") <= t["hi"])).alias("_t"),
        )
        .select(
            *keys,
            "_n",
            F.col("_t.target").alias("_target"),
            F.col("_t.position").alias("_position"),
            F.when(F.col("_v") >= F.col("_t.lo"), F.col("_v")).alias("_v"),
        )
        .groupBy(*keys, "_n", "_target", "_position", "_v")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    upto = Window.partitionBy(*keys, "_target").orderBy(F.col("_v").asc_nulls_first())
    ranked = hits.withColumn("_end", F.sum("_rows").over(upto)).withColumn(
        "_start", F.col("_end") - F.col("_rows")
    )

    def at(position: Column) -> Column:
        here = (F.col("_start") <= position) & (position < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    found = ranked.groupBy(*keys, "_n", "_target", "_position").agg(
        at(F.floor("_position")).alias("low"), at(F.ceil("_position")).alias("high")
    )
    lost = F.raise_error(F.lit("order statistic outside its bracket"))
    checked = found.withColumns(
        {c: F.when(F.col(c).isNull(), lost.cast(df.schema[value].dataType)).otherwise(F.col(c)) for c in ("low", "high")}
    )
    return checked if groups else checked.drop("_all")


def exact_quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    fractions: list[float],
    interpolate: bool = True,
    accuracy: int = 10_000,
    out: str = "q",
) -> DataFrame:
    """Exact quantiles as (groups..., n, q array) with q in the order of ``fractions``.

    With ``interpolate`` the value lies linearly between its neighbours, otherwise it is the
    lower one (the lower median at 0.5).
    """
    stats = exact_order_statistics(df, groups, value, fractions, accuracy)
    share = F.col("_position") - F.floor("_position")
    step = F.col("high") - F.col("low")
    linear = F.when(share < 0.5, F.col("low") + step * share).otherwise(
        F.col("high") - step * (1 - share)
    )
    exact = F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).otherwise(linear)
    stats = stats.withColumn("_q", exact if interpolate else F.col("low"))
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("_target", "_q"))), lambda s: s["_q"]
    )
    return stats.groupBy(*groups, F.col("_n").alias("n")).agg(listed.alias(out))


def equal_slices(df: DataFrame, n_slices: int, id: str = "row_id", out: str = "slice") -> DataFrame:
    """Number consecutive, near-equal slices of the rows in ``id`` order (first ones longer).

    Slice starts are exact order statistics of the id, so no global sort is needed.
    """
    ids = df.select(F.col(id).cast("long").alias("_id"))
    total = ids.count()
    sizes = [total // n_slices + (1 if i < total % n_slices else 0) for i in range(n_slices)]
    starts, at = [], 0
    for size in sizes[:-1]:
        at += size
        if at < total:
            starts.append(at)
    if not starts:
        return df.withColumn(out, F.lit(0))
    fractions = [s / (total - 1) for s in starts]
    cuts = exact_order_statistics(ids, [], "_id", fractions)
    # Rounding of s / (total - 1) * (total - 1) may fall a hair beside the whole position.
    nearest = F.when(
        F.col("_position") - F.floor("_position") < 0.5, F.col("low")
    ).otherwise(F.col("high"))
    bounds = [r[0] for r in cuts.select(nearest.alias("cut")).collect()]
    number = F.lit(0)
    for cut in bounds:
        number = number + (F.col(id) >= cut).cast("int")
    return df.withColumn(out, number)
