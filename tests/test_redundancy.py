"""The pruned cosine join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import redundancy
from tests.test_pairs import components_by_hand


def vectors(kind, n=600, d=12):
    rng = np.random.default_rng(len(kind))
    if kind == "random":
        return rng.normal(size=(n, d))
    centers = rng.normal(size=(40, d))
    if kind == "clusters":
        return centers[rng.integers(0, 40, n)] + 0.02 * rng.normal(size=(n, d))
    if kind == "hot cluster":  # a third of all rows around one point, some of them equal
        x = centers[rng.integers(0, 40, n)] + 0.02 * rng.normal(size=(n, d))
        x[: n // 3] = centers[0] + 0.001 * rng.normal(size=(n // 3, d))
        x[: n // 6] = centers[0]
        return x
    x = rng.integers(-1, 2, size=(n, d)).astype(float) * (rng.random((n, d)) < 0.3)  # many zeros and ties
    return x


def all_pairs(x):
    norms = np.linalg.norm(x, axis=1)
    unit = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0)
    sims = unit @ unit.T
    np.fill_diagonal(sims, 0.0)
    return sims


@pytest.mark.parametrize("kind", ["random", "clusters", "hot cluster", "ties"])
def test_pruned_join_equals_all_pairs(spark, kind):
    x = vectors(kind)
    sims = all_pairs(x)
    rows = [(i * 7, f"t{i}", row.tolist()) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>").repartition(3)
    table, n_components = redundancy.redundancy(df, 0.75, 32)
    for r in table.collect():
        i = r.id // 7
        best = sims[i].max()
        assert r.semantic_redundancy == pytest.approx(best, abs=1e-12)
        tied = np.flatnonzero(sims[i] > best - 1e-12)
        assert int(r.semantic_neighbor[1:]) in tied
        if kind == "ties" and best == 0:
            assert int(r.semantic_neighbor[1:]) == tied[0]
    pairs = [(i, int(j)) for i in range(len(x)) for j in [i, *np.flatnonzero(sims[i] > 0.75)]]
    assert n_components == len(set(components_by_hand(pairs).values()))


def test_clusters_are_compared_in_part(spark):
    n = 4000
    x = vectors("clusters", n)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<double>")
    found = redundancy.compare_vectors(df, 0.9, 64)
    compared = found.filter("kind = 2").agg(F.sum("similarity")).first()[0]
    assert compared < 0.1 * n * n
    assert found.filter("kind = 1").count() <= 6 * n


def test_a_hot_cluster_is_split(spark):
    x = vectors("hot cluster", 3000)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<double>")
    unit = np.array([v / np.linalg.norm(v) for v in x])
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(unit)], "id long, embedding array<double>")
    blocks = redundancy._in_blocks(points, 3000, redundancy.spread_pivots(unit[:500], 16), 64)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] < 3 * 64
    assert df.count() == blocks.count()


def test_float_vectors_and_few_rows(spark):
    df = spark.createDataFrame([(3, "a", [1.0, 0.0]), (1, "b", [0.0, 0.0])], "id int, text string, embedding array<float>")
    table, components = redundancy.redundancy(df, 0.5)
    assert {r.id: (r.semantic_redundancy, r.semantic_neighbor) for r in table.collect()} == {3: (0.0, "b"), 1: (0.0, "b")}
    assert components == 2
    _, together = redundancy.redundancy(df, -0.5)
    assert together == 1
