"""Linear probes: how well features predict the label."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import matrix_of
from pairlens.operators.linear import Design, add_over_tasks, build_design, tasks_for
from pairlens.operators.stats import accuracy, is_binary_label, pearson, roc_auc


def feature_vector(*parts: Column) -> Column:
    """One array of doubles from arrays and scalars (wrap a scalar in ``F.array``)."""
    return F.concat(*[F.transform(p, lambda v: v.cast("double")) for p in parts])


def labels_are_binary(df: DataFrame, label: str = "label") -> bool:
    row = df.agg(F.min(is_binary_label(F.col(label)).cast("int"))).first()
    return row[0] == 1


def _as_vectors(df: DataFrame, features: str, label: str, keep: list[str]) -> DataFrame:
    return df.select(
        *keep, array_to_vector(F.col(features)).alias("_x"), F.col(label).cast("double").alias("_y")
    )


def fit_probe(
    train: DataFrame, features: str = "features", label: str = "label",
    c: float = 1.0, binary: bool = True, standardize: bool = True,
):
    """Fitted MLlib model with the penalty of a logistic (1/2c) or ridge (alpha = c) objective.

    MLlib divides the loss by the rows and scales by the sample deviation; the population
    deviation asked for differs by n / (n - 1), which moves into the penalty. ``train`` is read
    a few times and should be stored or persisted.
    """
    rows = _as_vectors(train, features, label, [])
    n, spread, width = rows.agg(
        F.count(F.lit(1)), F.stddev_pop("_y"), F.max(F.size(vector_to_array("_x")))
    ).first()
    # MLlib keeps the rows as blocks while it iterates; few tasks suffice for few bytes.
    packed = rows.coalesce(tasks_for(n * (width or 0) * 8))
    if binary:
        penalty = 1.0 / (c * n) * ((n - 1) / n if standardize and n > 1 else 1.0)
        return LogisticRegression(
            featuresCol="_x", labelCol="_y", regParam=penalty, elasticNetParam=0.0,
            standardization=standardize, maxIter=1000, tol=1e-8,
        ).fit(packed)
    return LinearRegression(
        featuresCol="_x", labelCol="_y", regParam=c / n * spread, elasticNetParam=0.0,
        standardization=standardize, solver="auto", maxIter=1000, tol=1e-9,
    ).fit(packed)


def probe_scores(model, df: DataFrame, features: str = "features", label: str = "label", id: str = "row_id") -> DataFrame:
    """(id, label, score): probability of label 1, or the predicted value."""
    scored = model.transform(_as_vectors(df, features, label, [id]))
    score = (
        vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    )
    return scored.select(id, F.col("_y").alias("label"), score.alias("score"))


def evaluate_probe(model, train: DataFrame, val: DataFrame, features: str = "features", label: str = "label", binary: bool = True, id: str = "row_id") -> DataFrame:
    """(split, score[, accuracy]): AUC and accuracy, or the correlation for a numeric label."""
    both = probe_scores(model, train, features, label, id).withColumn("split", F.lit("train")).unionByName(
        probe_scores(model, val, features, label, id).withColumn("split", F.lit("val"))
    )
    if not binary:
        return both.groupBy("split").agg(pearson(F.col("label"), F.col("score")).alias("score"))
    auc = roc_auc(both, "label", "score", ("split",)).select("split", F.col("auc").alias("score"))
    return auc.join(accuracy(both, "label", "score", by=("split",)), "split")


def linear_probe(
    train: DataFrame, val: DataFrame, features: str = "features", label: str = "label",
    c: float = 1.0, binary: bool | None = None, standardize: bool = True, id: str = "row_id",
) -> DataFrame:
    """Fit on ``train`` and report both splits; the kind of label is detected if not given."""
    if binary is None:
        binary = labels_are_binary(train, label)
    model = fit_probe(train, features, label, c, binary, standardize)
    return evaluate_probe(model, train, val, features, label, binary, id)


@dataclass(frozen=True)
class Probes:
    """Several probes over one design: for each the positions it reads and its coefficients there,
    the intercept last, on standardised columns."""

    names: list[str]
    positions: list[np.ndarray]
    coefs: list[np.ndarray]
    design: Design
    controls: list[str]
    classification: bool

    def scores(self, df: DataFrame, acts: str = "acts", label: str = "label") -> DataFrame:
        """(probe, label, score) of every row by every probe, in one pass over the rows."""
        weights = np.zeros((self.design.width, len(self.names)))
        for j, (at, coefs) in enumerate(zip(self.positions, self.coefs)):
            weights[at, j] = coefs[:-1]
        intercepts = np.array([c[-1] for c in self.coefs])
        scaling, binary = self.design.scaling, self.classification

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                f = scaling(matrix_of(batch.column(0))) @ weights + intercepts
                found = 0.5 * (1.0 + np.tanh(0.5 * f)) if binary else f
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(intercepts)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(found).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["label", "scores"])

        numbers = F.array(*[F.col(c).cast("double") for c in self.controls]).cast("array<double>")
        x = feature_vector(numbers, F.col(acts))
        scored = df.select(x, F.col(label).cast("double")).mapInArrow(over, "label double, scores array<double>")
        named = F.element_at(F.array(*[F.lit(n) for n in self.names]), F.col("pos") + 1)
        return scored.select("label", F.posexplode("scores").alias("pos", "score")).select(named.alias("probe"), "label", "score")


def _logistic_steps(design: Design, positions: list[np.ndarray], penalty: float, max_steps: int = 60) -> list[np.ndarray]:
    """Newton's method for all probes side by side; a pass over the data serves those not settled."""
    scaling, n = design.scaling, design.n
    coefs = [np.zeros(len(at) + 1) for at in positions]
    last: list = [None] * len(positions)  # the point before a step, its objective and the step
    open_ones = list(range(len(positions)))
    for _ in range(max_steps):
        sizes = [1 + len(coefs[j]) * (1 + len(coefs[j])) for j in open_ones]

        def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z, parts = scaling(x), []
            for j in open_ones:
                own = np.column_stack([z[:, positions[j]], np.ones(len(z))])
                f = own @ coefs[j]
                prob = 0.5 * (1.0 + np.tanh(0.5 * f))
                hess = (own * (prob * (1 - prob))[:, None]).T @ own
                parts += [[(np.logaddexp(0.0, f) - y * f).sum()], own.T @ (prob - y), hess.ravel()]
            return np.concatenate(parts)

        sums = add_over_tasks(design.packed, kernel, sum(sizes)) / n
        still = []
        for j, part in zip(open_ones, np.split(sums, np.cumsum(sizes)[:-1])):
            m = len(coefs[j])
            shrink = np.full(m, penalty)
            shrink[-1] = 0.0
            value = part[0] + 0.5 * (shrink * coefs[j] ** 2).sum()
            if last[j] is not None and value > last[j][1] + 1e-12:
                before, held, step = last[j]
                last[j] = before, held, step / 2
                coefs[j] = before + step / 2
                still.append(j)
                continue
            grad = part[1 : m + 1] + shrink * coefs[j]
            step = -np.linalg.lstsq(part[m + 1 :].reshape(m, m) + np.diag(shrink), grad, rcond=None)[0]
            if np.abs(step).max() < 1e-10 or np.abs(grad).max() < 1e-12:
                continue
            last[j] = coefs[j], value, step
            coefs[j] = coefs[j] + step
            still.append(j)
        open_ones = still
        if not open_ones:
            break
    else:
        warnings.warn(f"{len(open_ones)} probes did not settle in {max_steps} steps", RuntimeWarning, stacklevel=3)
    return coefs


def _ridge(design: Design, positions: list[np.ndarray], alpha: float) -> list[np.ndarray]:
    p = design.width + 1
    scaling = design.scaling

    def second_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([scaling(x), np.ones(len(x))])
        return np.concatenate([z.T @ y, (z.T @ z).ravel()])

    sums = add_over_tasks(design.packed, second_moments, p + p * p)
    zy, zz = sums[:p], sums[p:].reshape(p, p)
    out = []
    for at in positions:
        own = np.r_[at, p - 1]
        shrink = np.full(len(own), alpha)
        shrink[-1] = 0.0
        out.append(np.linalg.lstsq(zz[np.ix_(own, own)] + np.diag(shrink), zy[own], rcond=None)[0])
    return out


@dataclass
class ProbeTask:
    """A probe to fit: the features it reads next to the controls (all, if None)."""

    name: str
    features: list[int] | None = None


def fit_probes(
    train: DataFrame, tasks: list[ProbeTask], controls: list[str], acts: str = "acts", label: str = "label",
    c: float = 1.0, classification: bool = True,
) -> Probes:
    """The probes of :func:`fit_probe` on several selections of features, all fitted in the same passes
    over the data: their number depends on the slowest fit, not on how many there are."""
    design = build_design(train, acts, label, controls)
    try:
        inputs = np.arange(design.n_controls)
        positions = [
            np.r_[inputs, design.n_controls + np.asarray(range(design.n_features) if t.features is None else t.features, dtype=int)]
            for t in tasks
        ]
        coefs = _logistic_steps(design, positions, 1.0 / (c * design.n)) if classification else _ridge(design, positions, c)
    finally:
        design.release()
    return Probes([t.name for t in tasks], positions, coefs, design, controls, classification)
