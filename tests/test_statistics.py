"""Order statistics, sampling, AUC, p-values and fidelity against numpy or brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions.special import pearson_p
from pairlens.operators import fidelity, sampling, stats
from pairlens.operators.ordered import cap_rows, equal_slices, exact_quantiles, hash_prefix_sum, top_n_per_group


@pytest.mark.parametrize("accuracy", [20, 10_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "tiny"])
def test_quantiles_equal_numpy(spark, accuracy, kind):
    rng = np.random.default_rng(0)
    n = 7 if kind == "tiny" else 6000
    values = rng.normal(size=n) if kind != "ties" else rng.integers(0, 4, n).astype(float)
    rows = [(int(i % 3 == 0), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    fractions = [0.0, 0.05, 0.5, 0.95, 1.0]
    for r in exact_quantiles(df, ["g"], "v", fractions, accuracy=accuracy).collect():
        own = np.array([v for g, v in rows if g == r.g])
        assert r.n == len(own)
        np.testing.assert_allclose(r.q, np.percentile(own, [100 * f for f in fractions]), rtol=1e-13, atol=1e-15)
    lower = exact_quantiles(df, [], "v", [0.5], interpolate=False, accuracy=accuracy).first()
    assert lower.q[0] == np.sort(values)[(n - 1) // 2]


def test_lower_median_takes_the_lower_middle(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double")
    assert exact_quantiles(df, [], "v", [0.5], interpolate=False).first().q == [2.0]
    assert exact_quantiles(df, [], "v", [0.5]).first().q == [2.5]


@pytest.mark.parametrize("n,k", [(101, 8), (5, 8), (1000, 32), (64, 32), (1, 4), (33, 32)])
def test_slices_equal_array_split(spark, n, k):
    ids = [3 * i + 7 for i in range(n)]
    got = equal_slices(spark.createDataFrame([(i,) for i in ids], "row_id long"), k).collect()
    want = {i: s for s, part in enumerate(np.array_split(ids, k)) for i in part}
    assert {r.row_id: r.slice for r in got} == want


def test_cap_rows_is_exact_and_independent_of_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    first = {r.row_id for r in cap_rows(df, 777).collect()}
    again = {r.row_id for r in cap_rows(df.repartition(13), 777).collect()}
    assert len(first) == 777 and first == again
    assert cap_rows(df, 9999).count() == 5000
    assert first != {r.row_id for r in cap_rows(df, 777, seed=1).collect()}


def test_prefix_sum_covers_every_row_once(spark):
    sizes = [(i, 1 + i % 5) for i in range(400)]
    df = spark.createDataFrame(sizes, "c long, size long")
    out = hash_prefix_sum(df, 42, "c", F.col("size")).collect()
    total = sum(s for _, s in sizes)
    cursor = 0
    for r in sorted(out, key=lambda r: r.before):
        assert r.before == cursor and r.total == total
        cursor += r["size"]
    assert cursor == total


def test_top_n_of_a_dominant_group(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 2500, 0).otherwise(1).alias("g"))
    got = top_n_per_group(df, ["g"], [F.col("row_id").desc()], 5).collect()
    assert sorted((r.g, r.row_id) for r in got) == [(0, i) for i in range(2495, 2500)] + [(1, i) for i in range(2995, 3000)]


def brute_auc(y, s):
    pos, neg = [x for x, l in zip(s, y) if l == 1], [x for x, l in zip(s, y) if l == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [2, 40, 10**6])
def test_auc(spark, levels):
    rng = np.random.default_rng(levels)
    y = rng.integers(0, 2, 1500)
    s = np.round(rng.normal(size=1500) + 0.3 * y, 9) if levels > 1000 else rng.integers(0, levels, 1500).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, s)], "label double, score double")
    assert stats.roc_auc(df).first().auc == pytest.approx(brute_auc(y, s), abs=1e-12)
    flipped = df.withColumn("score", -F.col("score"))
    assert stats.roc_auc(flipped).first().auc == pytest.approx(1 - brute_auc(y, s), abs=1e-12)


def test_auc_of_one_class_is_null_and_other_labels_are_ignored(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.3), (0.5, 0.9)], "label double, score double")
    row = stats.roc_auc(df).first()
    assert row.auc is None and row.n_pos == 2 and row.n_neg == 0


def test_standardise_leaves_a_constant_centred(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "row_id long, a double, b double")
    got = stats.standardise(df, None, ["a", "b"])[0].orderBy("row_id").collect()
    assert [(r.a, r.b) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_p_values_against_tabulated_t_quantiles():
    # Two-sided critical values of Student's t at 5 % and 1 %.
    for dof, t, p in [(1, 12.7062047, 0.05), (5, 2.5705818, 0.05), (10, 3.1692727, 0.01), (30, 2.0422725, 0.05), (120, 2.6174213, 0.01)]:
        r = t / math.sqrt(dof + t * t)
        assert pearson_p(r, dof + 2) == pytest.approx(p, rel=1e-6)
        assert pearson_p(-r, dof + 2) == pytest.approx(p, rel=1e-6)
    assert pearson_p(1.0, 10) == 0.0 and pearson_p(0.0, 10) == pytest.approx(1.0)
    assert pearson_p(0.5, 2) == 1.0 and math.isnan(pearson_p(float("nan"), 9))
    assert 0 < pearson_p(0.9, 300) < 1e-100


def activations(spark):
    """Neuron 0 fires both ways, neuron 1 never, neuron 2 twice."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a = rng.normal() if i % 2 else 0.0
        rows.append((i, [a, 0.0, 1.0 if i in (5, 6) else 0.0]))
    return rows, spark.createDataFrame(rows, "row_id long, acts array<float>")


def test_samplers_respect_their_bins(spark):
    rows, acts = activations(spark)
    values = {i: np.float32(a[0]) for i, a in rows}
    fired = np.array([v for v in values.values() if v != 0], dtype=float)
    out = [r for r in sampling.sample_percentile_bins(acts, 60, (50, 100), (0, 50)).collect()]
    p50 = np.percentile(fired, 50)
    mine = [r for r in out if r.neuron_idx == 0]
    assert sum(r.is_positive for r in mine) == 30 and len(mine) == 60
    assert all((r.act >= p50) if r.is_positive else (r.act <= p50) for r in mine)
    assert {r.neuron_idx for r in out} == {0, 2}
    silent = sampling.sample_percentile_bins(acts, 20).collect()
    assert all(r.act == 0 for r in silent if not r.is_positive) and 1 not in {r.neuron_idx for r in silent}

    strong = sampling.sample_top_only(acts, 5, (95, 100), candidates=2).collect()
    cut = np.percentile(np.abs(fired), 95)
    assert all(abs(r.act) >= cut for r in strong if r.neuron_idx == 0)
    # A neuron that never fires falls back to any rows.
    assert sum(r.neuron_idx == 1 and r.candidate_idx == 0 for r in strong) == 5
    assert sum(r.neuron_idx == 2 and r.candidate_idx == 1 for r in strong) == 2

    top = sampling.sample_top_zero(acts, 10, seed=3).collect()
    best = sorted(values, key=lambda i: -values[i])[:5]
    assert {r.row_id for r in top if r.neuron_idx == 0 and r.is_positive} == set(best)
    assert {r.row_id for r in top if r.neuron_idx == 2 and r.is_positive} > {5, 6}
    everything = sampling.sample_top_only(acts, 7).collect()
    assert len([r for r in everything if r.neuron_idx == 0]) == 7


def metric(spark, pairs):
    rows = [(0, "i", float(a), int(y), int(p)) for a, y, p in pairs]
    df = spark.createDataFrame(rows, "neuron_idx int, interpretation string, act double, annotation int, is_positive int")
    return fidelity.correlation_metrics(df).first()


def test_fidelity_metrics(spark):
    m = metric(spark, [(1, 1, 1), (2, 1, 1), (0, 0, 0), (0.5, 1, 0)])
    assert m.recall == 1.0 and m.precision == 0.5 and m.f1 == pytest.approx(2 / 3)
    assert m.correlation == pytest.approx(np.corrcoef([1, 2, 0, 0.5], [1, 1, 0, 1])[0, 1])
    m = metric(spark, [(1, 1, 1), (2, 1, 0)])
    assert m.correlation == 0.0 and m.n is None
    m = metric(spark, [(1, 1, 1), (2, -1, 0)])
    assert m.correlation == pytest.approx(-1.0) and m.f1 == 0.0
    assert math.isnan(metric(spark, [(1, 1, 1), (1, 0, 0)]).correlation)


def test_description_without_annotations_and_tie_breaking(spark):
    samples = spark.createDataFrame([(0, "t1", 1.0, 1), (0, "t2", 0.0, 0)], "neuron_idx int, text_key string, act double, is_positive int")
    interps = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (0, 2, "y"), (1, 0, "x")], "neuron_idx int, candidate_idx int, interpretation string")
    notes = spark.createDataFrame([("y", "t1", 1), ("y", "t2", 0)], "c string, text_key string, annotation int").select(
        F.sha2("c", 256).alias("concept_key"), "text_key", "annotation"
    )
    out = {(r.neuron_idx, r.interpretation): r for r in fidelity.fidelity(samples, notes, interps).collect()}
    assert len(out) == 3
    assert (out[0, "x"].correlation, out[0, "x"].p_value) == (0.0, 1.0)
    assert out[0, "y"].correlation == pytest.approx(1.0) and out[0, "y"].candidate_idx == 1
    best = {r.neuron_idx: r.interpretation for r in fidelity.best_candidates(fidelity.fidelity(samples, notes, interps)).collect()}
    assert best == {0: "y", 1: "x"}
    tied = spark.createDataFrame([(0, 1, "b", 0.5, 0.1), (0, 0, "a", 0.5, 0.1), (1, 0, "c", float("nan"), float("nan"))],
                                 "neuron_idx int, candidate_idx int, interpretation string, correlation double, p_value double")
    best = fidelity.best_candidates(tied)
    assert {r.interpretation for r in best.collect()} == {"a", "c"}
    assert [r.neuron_idx for r in fidelity.faithful(best, 0.0, 0.2).collect()] == [0]
    assert fidelity.faithful(best, 0.0, 0.05).count() == 0
    assert fidelity.mean_abs_correlation(best).first()[0] == 0.5
