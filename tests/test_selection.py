"""L1 paths and probes on columns that are nearly, or exactly, the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import linear, probe
from tests.test_models import labelled, newton, scaled


def hard_design(rng, n, p, kind):
    z = rng.normal(size=(n, p))
    if kind == "equal":
        z[:, 1] = z[:, 0]
    elif kind == "constant":
        z[:, 1] = 3.0
    elif kind == "few rows":
        z = rng.normal(size=(p // 2 + 1, p))
    elif kind == "sum":
        z[:, 2] = z[:, 0] + z[:, 1]
    else:
        z[:, 1] = z[:, 0] + float(kind) * rng.normal(size=n)
    return z


@pytest.mark.parametrize("kind", ["equal", "constant", "few rows", "sum", *[f"1e-{k}" for k in range(1, 7)]])
def test_quadratic_with_penalty_is_solved_exactly(kind):
    rng = np.random.default_rng(len(kind))
    for trial in range(60):
        p = int(rng.integers(4, 14))
        z = hard_design(rng, int(rng.integers(20, 200)), p, kind)
        y = z[:, 0] + rng.normal(size=len(z))
        hess, c = z.T @ z / len(z), z.T @ y / len(z)
        penalised = rng.random(p) < 0.85
        alpha = 10.0 ** rng.uniform(-6, 0.5)
        start = rng.normal(size=p) * (rng.random(p) < 0.5)
        for beta in (np.zeros(p), start):
            best = linear.solve_quadratic(hess @ beta - c, hess, beta, alpha, penalised)
            assert linear.violation(hess @ best - c, best, alpha, penalised).max() < 1e-8


def near_copies(spark, noise, n=500):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3))
    acts = np.column_stack([x[:, 0], x[:, 0] + noise * rng.normal(size=n), x[:, 1], x[:, 1], x[:, 2], np.zeros(n)])
    y = (x @ [1.5, -1.0, 0.3] + rng.logistic(size=n) > 0).astype(float)
    length = rng.normal(size=n) + x[:, 2]
    rows = [(i, float(y[i]), float(length[i]), acts[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label double, length_delta double, acts array<double>").repartition(3)


@pytest.mark.parametrize("noise", [0.0, 1e-1, 1e-2, 1e-3, 1e-4, 1e-6])
def test_path_over_near_copies_is_optimal(spark, noise):
    df = near_copies(spark, noise)
    with linear.lasso_search(df, ["length_delta"]) as path:
        for size in (1, 2, 3, 5):
            try:
                path.select(size)
            except ValueError:
                pass
        assert len(path.known) > 5
        for alpha, fit in path.known.items():
            at = path.evaluate([fit.beta])[0]
            assert linear.violation(at[1], fit.beta, alpha, path.penalised).max() < 1e-8


def test_penalties_share_their_passes(spark):
    df, *_ = labelled(spark)
    with linear.lasso_search(df, ["length_delta"]) as one, linear.lasso_search(df, ["length_delta"]) as many:
        trail = linear.search_penalty(one.coefs, 3, rounds=30)
        alone = one.passes
        many.select(3)
        assert many.passes <= alone / 2 or alone < 10
        for t in trail:
            np.testing.assert_allclose(many.coefs(t.alpha), t.coefs, atol=1e-7)


@pytest.mark.parametrize("binary", [True, False])
def test_probes_together_equal_single_fits(spark, binary):
    df, acts, length, y = labelled(spark, n=400, binary=binary)
    tasks = [probe.ProbeTask("one", [0]), probe.ProbeTask("three", [4, 0, 2]), probe.ProbeTask("all")]
    scores = probe.fit_probes(df, tasks, ["length_delta"], c=0.5, classification=binary).scores(df)
    got = {t.name: sorted((r.label, r.score) for r in scores.filter(F.col("probe") == t.name).collect()) for t in tasks}
    for t in tasks:
        x = np.column_stack([length, acts if t.features is None else acts[:, t.features]])
        z = scaled(x)
        if binary:
            b = newton(z, y, ridge=2.0)
            want = 1 / (1 + np.exp(-(z @ b[:-1] + b[-1])))
        else:
            b = np.linalg.solve(z.T @ z + 0.5 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
            want = z @ b + y.mean()
        np.testing.assert_allclose([s for _, s in got[t.name]], [s for _, s in sorted(zip(y, want))], atol=1e-8)


def test_passes_do_not_grow_with_the_number_of_probes(spark, monkeypatch):
    df, *_ = labelled(spark, n=300)
    passes = []
    real = probe.add_over_tasks
    monkeypatch.setattr(probe, "add_over_tasks", lambda *a: passes.append(1) or real(*a))
    counts = []
    for n in (1, 12):
        passes.clear()
        probe.fit_probes(df, [probe.ProbeTask("all"), *[probe.ProbeTask(f"p{i}", [i % 5]) for i in range(n)]], ["length_delta"])
        counts.append(len(passes))
    assert counts[1] <= counts[0] + 1


def test_probe_without_controls_or_spread(spark):
    rows = [(i, float(i % 2), [1.0, float(i % 2), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, label double, acts array<double>")
    scores = probe.fit_probes(df, [probe.ProbeTask("all"), probe.ProbeTask("none", [])], []).scores(df)
    assert scores.filter("isnan(score)").isEmpty()
    assert {round(r.score, 6) for r in scores.filter("probe = 'none'").collect()} == {0.5}
