"""L1 feature selection and controlled coefficients from distributed second moments.

A fit never moves rows: each Newton step is one pass in which tasks reduce their rows to a
gradient and a small Hessian, an aggregation adds those up, and the driver solves a system of
the size of the model.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.vectors import matrix_of
from pairlens.operators.ordered import cap_rows


BYTES_PER_TASK = 64 << 20


def tasks_for(n_bytes: int) -> int:
    """Tasks an iterative job needs for cached data of this size; never more than there are."""
    return max(1, -(-n_bytes // BYTES_PER_TASK))


def add_over_tasks(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum of ``kernel(x, y)`` over all batches of a design (x array, y double)."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(matrix_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], names=["pos", "value"]
            )

    sums = df.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    out = np.zeros(length)
    for pos, value in sums.collect():
        out[pos] = value
    return out


@dataclass
class Scaling:
    """Column moments, the part of a design that travels with the tasks."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale


@dataclass
class Design:
    """Persisted (x, y) rows with the controls first; scaling is applied on the fly.

    ``packed`` are the same rows in as few tasks as their size allows.
    """

    rows: DataFrame
    packed: DataFrame
    n_controls: int
    n_features: int
    n: float
    scaling: Scaling

    @property
    def width(self) -> int:
        return self.n_controls + self.n_features

    def release(self) -> None:
        self.rows.unpersist()


def build_design(df: DataFrame, acts: str, label: str, controls: list[str], standardize: bool = True) -> Design:
    as_double = F.transform(F.col(acts), lambda v: v.cast("double"))
    x = F.concat(F.array(*[F.col(c).cast("double") for c in controls]), as_double) if controls else as_double
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y")).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n_rows:
        raise ValueError("no rows to fit on")
    packed = rows.coalesce(tasks_for(n_rows * width * 8))

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0)])

    sums = add_over_tasks(packed, moments, width + 1)
    n, mean = sums[0], sums[1:] / sums[0]

    def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((x - mean) ** 2).sum(axis=0)

    if standardize:
        deviation = np.sqrt(add_over_tasks(packed, squares, width) / n)
        scale = np.where(deviation > 0, deviation, 1.0)
    else:
        mean, scale = np.zeros(width), np.ones(width)
    return Design(rows, packed, len(controls), width - len(controls), n, Scaling(mean, scale))


Evaluation = tuple[float, np.ndarray, np.ndarray]


def _evaluator(design: Design, classification: bool) -> Callable[[list[np.ndarray]], list[Evaluation]]:
    """Mean loss, gradient and Hessian as functions of (coefficients, intercept).

    One pass over the data serves any number of points.
    """
    p = design.width + 1
    scaling = design.scaling
    size = 1 + p + p * p

    def with_intercept(x: np.ndarray) -> np.ndarray:
        return np.column_stack([scaling(x), np.ones(len(x))])

    def unpack(sums: np.ndarray) -> Evaluation:
        return sums[0] / design.n, sums[1 : p + 1] / design.n, sums[p + 1 :].reshape(p, p) / design.n

    if classification:

        def logistic(betas: list[np.ndarray]) -> list[Evaluation]:
            def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                z = with_intercept(x)
                parts = []
                for beta in betas:
                    f = z @ beta
                    prob = 1.0 / (1.0 + np.exp(-np.clip(f, -700, 700)))
                    loss = np.logaddexp(0.0, f) - y * f
                    hess = (z * (prob * (1 - prob))[:, None]).T @ z
                    parts += [[loss.sum()], z.T @ (prob - y), hess.ravel()]
                return np.concatenate(parts)

            sums = add_over_tasks(design.packed, kernel, size * len(betas))
            return [unpack(part) for part in np.split(sums, len(betas))]

        return logistic

    def second_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = with_intercept(x)
        return np.concatenate([[(y**2).sum()], z.T @ y, (z.T @ z).ravel()])

    # The squared loss is determined by one pass over the data, whatever the penalty.
    yy, zy, zz = unpack(add_over_tasks(design.packed, second_moments, size))

    def squared(betas: list[np.ndarray]) -> list[Evaluation]:
        return [(0.5 * (yy - 2 * zy @ b + b @ zz @ b), zz @ b - zy, zz) for b in betas]

    return squared


def violation(grad: np.ndarray, beta: np.ndarray, alpha: float, penalised: np.ndarray) -> np.ndarray:
    """By how much each coefficient misses the optimality conditions of the L1 problem."""
    moving = ~penalised | (beta != 0)
    pull = np.where(penalised, alpha * np.sign(beta), 0.0)
    return np.where(moving, np.abs(grad + pull), np.maximum(np.abs(grad) - alpha, 0.0))


def solve_quadratic(
    grad: np.ndarray, hess: np.ndarray, beta: np.ndarray, alpha: float, penalised: np.ndarray
) -> np.ndarray:
    """Exact minimiser of the quadratic model at ``beta`` plus the L1 penalty.

    An active set with signs: the model is solved on the coefficients that move, with their signs
    held, and the best point on the way there is taken, where a coefficient may have become zero
    and leaves; then the coefficient that misses its condition most joins. Every step lowers the
    objective, so no set comes twice. The Hessian may be singular, as with equal, constant or nearly
    collinear columns: along directions without curvature the step ends where a coefficient does.
    """
    scale = np.sqrt(np.maximum(np.diag(hess), 0.0))
    dead = scale <= 1e-12 * max(scale.max(initial=0.0), 1.0)  # constant columns
    scale = np.where(dead, 1.0, scale)
    h = hess / np.outer(scale, scale)
    weight = np.where(penalised, alpha / scale, 0.0)  # penalty on the scaled coefficients
    x = beta * scale
    linear = grad / scale - h @ x
    x = np.where(dead & penalised, 0.0, x)

    def objective(v: np.ndarray) -> float:
        return linear @ v + 0.5 * v @ h @ v + weight @ np.abs(v)

    sign = np.where(penalised, np.sign(x), 0.0)
    active = (~penalised | (x != 0)) & ~dead
    settled = False  # no better point with these signs, within rounding
    for _ in range(50 * len(x) + 100):
        slope = linear + h @ x
        tolerance = 1e-12 * max(1.0, np.abs(linear).max(initial=0.0)) + 1e-15 * np.abs(x).max(initial=0.0)
        rest = np.flatnonzero(active)
        miss = slope[rest] + weight[rest] * sign[rest]
        if settled or not len(rest) or np.abs(miss).max() <= tolerance:
            excess = np.where(active | dead, -np.inf, np.abs(slope) - weight)
            worst = int(np.argmax(excess))
            if excess[worst] <= tolerance:
                break
            active[worst], sign[worst], settled = True, -np.sign(slope[worst]), False
            rest = np.flatnonzero(active)
            miss = slope[rest] + weight[rest] * sign[rest]
        values, vectors = np.linalg.eigh(h[np.ix_(rest, rest)])
        curved = values > 1e-13 * max(values[-1], 1e-300)
        parts = vectors.T @ -miss
        flat = vectors[:, ~curved] @ parts[~curved]
        step = vectors[:, curved] @ (parts[curved] / values[curved])
        if np.abs(flat).max(initial=0.0) > tolerance:
            step = flat * (1e6 / np.abs(flat).max())  # until a coefficient becomes zero
        ends = np.where(sign[rest] != 0, -x[rest] / np.where(step == 0, np.inf, step), np.inf)
        stops = np.unique(ends[(ends > 0) & (ends < 1)])
        best, least = None, objective(x)
        for share in [*stops.tolist(), 1.0]:
            trial = x.copy()
            trial[rest] += share * step
            trial[rest[np.abs(ends - share) <= 1e-15]] = 0.0
            value = objective(trial)
            if best is None or value < least:
                best, least = trial, value
            elif value > least:
                break
        settled = np.array_equal(best, x) or least >= objective(x)
        x = best
        gone = penalised & active & (x == 0)
        sign = np.where(penalised & active & ~gone, np.sign(x), np.where(penalised, 0.0, sign))
        active &= ~gone
    return np.where(dead & ~penalised, beta, x / scale)


@dataclass
class Fit:
    """A penalised fit under way, and what is known at its coefficients."""

    alpha: float
    beta: np.ndarray
    at: Evaluation
    target: np.ndarray | None = None
    share: float = 1.0
    steps: int = 0

    def objective(self, penalised: np.ndarray) -> float:
        return self.at[0] + self.alpha * np.abs(self.beta[penalised]).sum()


def minimise(
    evaluate: Callable[[list[np.ndarray]], list[Evaluation]], fits: list[Fit], penalised: np.ndarray,
    tol: float = 1e-9, max_steps: int = 60,
) -> list[Fit]:
    """Proximal Newton with step halving for several penalties side by side.

    Each pass over the data evaluates the next point of every fit that has not settled.
    """
    open_fits = list(fits)
    while True:
        moving = []
        for fit in open_fits:
            if fit.target is None:
                if violation(fit.at[1], fit.beta, fit.alpha, penalised).max() <= tol:
                    continue
                if fit.steps >= max_steps:
                    warnings.warn(f"penalised fit at {fit.alpha:g} did not settle in {max_steps} steps", RuntimeWarning, stacklevel=2)
                    continue
                fit.target, fit.share = solve_quadratic(fit.at[1], fit.at[2], fit.beta, fit.alpha, penalised), 1.0
            moving.append(fit)
        if not moving:
            return fits
        trials = [f.beta + f.share * (f.target - f.beta) if f.share < 1 else f.target for f in moving]
        open_fits = []
        for fit, trial, there in zip(moving, trials, evaluate(trials)):
            fit.steps += 1
            value = there[0] + fit.alpha * np.abs(trial[penalised]).sum()
            if value <= fit.objective(penalised) + 1e-13 * max(1.0, abs(value)):
                fit.beta, fit.at, fit.target = trial, there, None
            elif fit.share < 1e-6:  # no better point in this direction within rounding
                continue
            else:
                fit.share /= 2
            open_fits.append(fit)


@dataclass
class Selection:
    """Selected features, strongest first, with their (standardised) coefficients."""

    neurons: list[int]
    coefs: list[float]
    alpha: float

    def table(self, spark) -> DataFrame:
        rows = [(int(i), float(c)) for i, c in zip(self.neurons, self.coefs)]
        return spark.createDataFrame(rows, "neuron_idx int, coef double")


def _strongest_first(coefs: np.ndarray, n: int, nonzero: bool) -> tuple[list[int], list[float]]:
    order = np.argsort(-np.abs(coefs), kind="stable")
    if nonzero:
        order = order[coefs[order] != 0]
    order = order[:n]
    return order.tolist(), coefs[order].tolist()


# Search range of the penalty.
ALPHA_RANGE = (1e-6, 1e4)


@dataclass(frozen=True)
class Trial:
    """A penalty that was tried, and the coefficients it gave."""

    alpha: float
    coefs: np.ndarray

    @property
    def found(self) -> int:
        return int(np.count_nonzero(self.coefs))


def search_penalty(
    fit: Callable[[float], np.ndarray], wanted: int, rounds: int,
    ahead: Callable[[list[float]], None] | None = None, depth: int = 3,
) -> list[Trial]:
    """Halve the range of log penalties towards ``wanted`` features; all trials in their order.

    More features than wanted send the search to the stronger half. It ends with a hit. Every
    ``depth`` rounds ``ahead`` is told all penalties that the next ones may try.
    """
    weakest, strongest = np.log(ALPHA_RANGE)
    width = strongest - weakest
    trail: list[Trial] = []

    def middles(low: float, span: float, levels: int) -> list[float]:
        if not levels:
            return []
        span /= 2
        return [float(np.exp(low + span)), *middles(low, span, levels - 1), *middles(low + span, span, levels - 1)]

    while len(trail) < rounds and not (trail and trail[-1].found == wanted):
        if ahead is not None and len(trail) % depth == 0:
            ahead(middles(weakest, width, min(depth, rounds - len(trail))))
        width /= 2
        alpha = float(np.exp(weakest + width))
        trail.append(Trial(alpha, fit(alpha)))
        weakest += width * (trail[-1].found > wanted)
    return trail


class LassoPath:
    """Solutions for several penalties on one design, each started from the nearest known one.

    ``passes`` counts how often the data was read.
    """

    def __init__(self, design: Design, classification: bool) -> None:
        self.design = design
        self.passes = 0
        self._evaluate = _evaluator(design, classification)
        self.penalised = np.zeros(design.width + 1, dtype=bool)
        self.penalised[design.n_controls : design.width] = True
        zero = np.zeros(design.width + 1)
        # With an infinite penalty only the controls and the intercept move.
        (null,) = minimise(self.evaluate, [Fit(1e30, zero, self.evaluate([zero])[0])], self.penalised)
        self.alpha_max = float(np.abs(null.at[1][self.penalised]).max(initial=0.0))
        null.alpha = max(self.alpha_max, 1e-300)
        self.known: dict[float, Fit] = {null.alpha: null}

    def evaluate(self, betas: list[np.ndarray]) -> list[Evaluation]:
        self.passes += 1
        return self._evaluate(betas)

    def fit(self, alphas: list[float]) -> None:
        """Fit the penalties that are not known yet, all in the same passes."""
        new = [a for a in dict.fromkeys(alphas) if a < self.alpha_max and a not in self.known]
        starts = [self.known[min(self.known, key=lambda k: abs(np.log(k) - np.log(a)))] for a in new]
        for done in minimise(self.evaluate, [Fit(a, s.beta, s.at) for a, s in zip(new, starts)], self.penalised):
            self.known[done.alpha] = done

    def coefs(self, alpha: float) -> np.ndarray:
        """Feature coefficients; above alpha_max all are zero without looking at the data."""
        if alpha >= self.alpha_max:
            return np.zeros(self.design.n_features)
        self.fit([alpha])
        return self.known[alpha].beta[self.design.n_controls : self.design.width]

    def select(self, n_select: int) -> Selection:
        """The fit that keeps exactly ``n_select`` features.

        If the search meets none, the sparsest fit that keeps more is cut to its strongest.
        """
        trail = search_penalty(self.coefs, n_select, rounds=30, ahead=self.fit)
        enough = [t for t in trail if t.found >= n_select]
        if not enough:
            raise ValueError("no penalty keeps enough features")
        sparsest = max(enough, key=lambda t: t.alpha)
        neurons, strongest = _strongest_first(sparsest.coefs, n_select, nonzero=True)
        return Selection(neurons, strongest, sparsest.alpha)


@contextmanager
def lasso_search(
    df: DataFrame,
    controls: list[str],
    acts: str = "acts",
    label: str = "label",
    classification: bool = True,
    max_samples: int | None = None,
    seed: int = 42,
    standardize: bool = True,
    id: str = "row_id",
) -> Iterator[LassoPath]:
    """Selections of several sizes from one design; fits they have in common are made once."""
    if max_samples is not None:
        df = cap_rows(df, max_samples, seed, id)
    design = build_design(df, acts, label, controls, standardize)
    try:
        yield LassoPath(design, classification)
    finally:
        design.release()


def controlled_lasso(df: DataFrame, n_select: int, controls: list[str], **options) -> Selection:
    """Features kept by an L1 penalty that spares the controls, see :func:`lasso_search`."""
    with lasso_search(df, controls, **options) as path:
        return path.select(n_select)


def lasso_select(
    df: DataFrame, n_select: int, acts: str = "acts", label: str = "label",
    classification: bool = False, alpha: float | None = None,
) -> Selection:
    """Plain L1 selection on standardised features: the strongest of the last fit.

    For classification ``alpha`` weighs the penalty against the summed (not mean) loss.
    """
    design = build_design(df, acts, label, [])
    try:
        path = LassoPath(design, classification)
        weight = design.n if classification else 1.0

        def fit(penalty: float) -> np.ndarray:
            return path.coefs(penalty / weight)

        last = Trial(alpha, fit(alpha)) if alpha is not None else search_penalty(
            fit, n_select, rounds=20, ahead=lambda penalties: path.fit([a / weight for a in penalties])
        )[-1]
        neurons, strongest = _strongest_first(last.coefs, n_select, nonzero=False)
        return Selection(neurons, strongest, last.alpha)
    finally:
        design.release()


COEF_SCHEMA = T.StructType(
    [T.StructField("neuron_idx", T.IntegerType()), T.StructField("coef", T.DoubleType())]
)


def controlled_coefs(
    df: DataFrame,
    controls: list[str],
    acts: str = "acts",
    label: str = "label",
    classification: bool = True,
    standardize: bool = True,
    max_steps: int = 35,
) -> DataFrame:
    """(neuron_idx, coef): label ~ 1 + controls + one feature, for every feature at once.

    All regressions share each pass: tasks add up one small system per feature. A feature whose
    system is singular gets a null coefficient, the others are unaffected.
    """
    design = build_design(df, acts, label, controls, standardize)
    try:
        coefs = _all_coefs(design, classification, max_steps)
    finally:
        design.release()
    rows = [(i, float(c) if np.isfinite(c) else None) for i, c in enumerate(coefs)]
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA)


def _all_coefs(design: Design, classification: bool, max_steps: int) -> np.ndarray:
    c, m = design.n_controls + 1, design.n_features
    beta = np.zeros((m, c + 1))
    size = m * ((c + 1) + (c + 1) * (c + 1))
    scaling = design.scaling

    def systems(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = scaling(x)
            shared = np.column_stack([np.ones(len(z)), z[:, : c - 1]])
            act = z[:, c - 1 :]
            f = shared @ beta[:, :c].T + act * beta[:, c]
            if classification:
                prob = 1.0 / (1.0 + np.exp(-np.clip(f, -700, 700)))
                resid, weight = y[:, None] - prob, prob * (1 - prob)
            else:
                resid, weight = y[:, None] - f, np.ones_like(f)
            grad = np.column_stack([resid.T @ shared, (resid * act).sum(axis=0)])
            hess = np.empty((m, c + 1, c + 1))
            for j in range(c):
                hess[:, j, :c] = (weight * shared[:, j : j + 1]).T @ shared
            cross = (weight * act).T @ shared
            hess[:, c, :c] = cross
            hess[:, :c, c] = cross
            hess[:, c, c] = (weight * act**2).sum(axis=0)
            return np.concatenate([grad.ravel(), hess.ravel()])

        sums = add_over_tasks(design.packed, kernel, size)
        return sums[: m * (c + 1)].reshape(m, c + 1), sums[m * (c + 1) :].reshape(m, c + 1, c + 1)

    solvable = np.ones(m, dtype=bool)
    for _ in range(max_steps if classification else 1):
        grad, hess = systems(beta)
        largest = 0.0
        for i in np.flatnonzero(solvable):
            diagonal = np.sqrt(np.diag(hess[i]))
            if (diagonal <= 0).any() or np.linalg.matrix_rank(hess[i] / np.outer(diagonal, diagonal), tol=1e-10) <= c:
                solvable[i] = False
                continue
            step = np.linalg.solve(hess[i], grad[i])
            beta[i] += step
            largest = max(largest, np.abs(step).max())
        if largest < 1e-8:
            break
    else:
        if classification and solvable.any():
            warnings.warn(f"some slopes did not settle in {max_steps} steps", RuntimeWarning, stacklevel=3)
    return np.where(solvable, beta[:, c], np.nan)
