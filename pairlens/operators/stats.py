"""Ranking and error statistics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut points between score buckets: every 16th is looked at first, then the 15 in between.
CUT_STRIDE = 16
N_CUTS = CUT_STRIDE**2 - 1


def _below(cuts: Column, score: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < score))


def _bucket_of(cuts: Column, coarse: Column, score: Column) -> Column:
    """Number of (ascending) cut points below the score; ``coarse`` is every 16th of them."""
    start = _below(coarse, score) * CUT_STRIDE
    return start + _below(F.slice(cuts, start + 1, CUT_STRIDE - 1), score)


def is_binary_label(label: Column) -> Column:
    return F.coalesce(label.isin(0, 1), F.lit(False))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where either side is constant."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), spread)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half: (by..., auc, n_pos, n_neg).

    Rows collapse to distinct scores first. The scores are cut into buckets of similar size;
    ranking inside a bucket and the totals over buckets are separate, so no task ever orders a
    whole group. The area is null when a class is absent.
    """
    keys = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    counts = (
        df.filter(is_binary_label(F.col(label)) & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("_s"))
        .agg(
            F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
        )
    )
    shares = [(i + 1) / (N_CUTS + 1) for i in range(N_CUTS)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_s", shares, 2000).alias("_cuts"))
    coarse = F.filter("_cuts", lambda c, i: (i + 1) % CUT_STRIDE == 0)
    cuts = cuts.select(*keys, F.struct("_cuts", coarse.alias("_coarse")).alias("_c"))
    if by:
        # Two short arrays per group; groups are splits or models, not data keys.
        placed = counts.join(F.broadcast(cuts), keys)
    else:
        placed = counts.withColumn("_c", cuts.select("_c").scalar())
    placed = placed.withColumn(
        "_bucket", _bucket_of(F.col("_c._cuts"), F.col("_c._coarse"), F.col("_s"))
    ).drop("_c")
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    )
    buckets = (
        placed.withColumn("_below", F.coalesce(F.sum("_neg").over(within), F.lit(0)))
        .groupBy(*keys, "_bucket")
        .agg(
            F.sum("_pos").alias("_p"),
            F.sum("_neg").alias("_n"),
            F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_wins"),
        )
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = (
        buckets.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.sum("_p").alias("n_pos"),
            F.sum("_n").alias("n_neg"),
            F.sum(F.col("_wins") + F.col("_p") * F.col("_ahead").cast("double")).alias("_u"),
        )
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.select(*by, F.try_divide("_u", pairs).alias("auc"), "n_pos", "n_neg")


def accuracy(df: DataFrame, label: str, score: str, threshold: float = 0.5, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose thresholded score equals the label (``strict``: above, not at)."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    return (
        df.filter(is_binary_label(F.col(label)))
        .groupBy(*by)
        .agg(F.avg((hit.cast("int") == F.col(label)).cast("double")).alias("accuracy"))
    )


def margin_evaluation(scores: DataFrame, label: str = "label", a: str = "score_A", b: str = "score_B", by: tuple[str, ...] = ()) -> DataFrame:
    """AUC and accuracy of ``score_A - score_B`` against the label: (by..., auc, accuracy)."""
    margins = scores.withColumn("_margin", (F.col(a) - F.col(b)).cast("double"))
    auc = roc_auc(margins, label, "_margin", by).drop("n_pos", "n_neg")
    acc = accuracy(margins, label, "_margin", 0.0, strict=True, by=by)
    return auc.join(acc, list(by)) if by else auc.withColumn("accuracy", acc.scalar())


def standardise(train: DataFrame, other: DataFrame | None, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(x - mean) / population deviation with moments of ``train``; a constant is only centred."""
    moments = train.agg(
        F.struct(
            *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"dev_{c}") for c in columns],
        )
    ).scalar()

    def scaled(df: DataFrame) -> DataFrame:
        known = df.withColumn("_moments", moments)
        values = {
            c: (F.col(c) - F.col(f"_moments.mean_{c}"))
            / F.when(F.col(f"_moments.dev_{c}") > 0, F.col(f"_moments.dev_{c}")).otherwise(F.lit(1.0))
            for c in columns
        }
        return known.withColumns(values).select(*df.columns)

    return scaled(train), None if other is None else scaled(other)


def normalised_mse(df: DataFrame, target: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Squared error over the error of predicting each group's column means: (by..., nmse)."""
    dims = (
        df.select(*by, F.posexplode(F.arrays_zip(F.col(target).alias("x"), F.col(predicted).alias("p"))).alias("_d", "_xp"))
        .select(*by, "_d", F.col("_xp.x").cast("double").alias("_x"), F.col("_xp.p").cast("double").alias("_p"))
        .groupBy(*by, "_d")
        .agg(
            F.sum((F.col("_x") - F.col("_p")) ** 2).alias("_err"),
            (F.var_pop("_x") * F.count("_x")).alias("_base"),
        )
    )
    return dims.groupBy(*by).agg(F.try_divide(F.sum("_err"), F.sum("_base")).alias("nmse"))
