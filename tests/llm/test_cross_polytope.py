import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import cross_polytope
from tests.llm.fixtures import SF


def brute(rows, k=10, step=100):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in {i: v for i, v in reversed(rows)}.items():
        if q % step == 0:
            near = {}
            for i, v in rows:
                if i != q and len(v) == len(x):
                    near[i] = min(near.get(i, np.inf), float(np.sqrt(((v - x) ** 2).sum())))
            out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    return {q: [(s, v) for _, s, v in sorted(x)] for q, x in out.items()}


def clusters(spark, n=3000, length=48):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, length))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, length)) * 0.5
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("table", ["data", "clusters"])
def test_recall_against_all_pairs(spark, table):
    rows = clusters(spark) if table == "clusters" else spark.read.parquet(f"{SF}/embeddings.parquet")
    got = answers(cross_polytope.nearest_neighbours(rows, F.col("id") % 20 == 0))
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], step=20)
    assert set(got) == set(want)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q in want:
        assert got[q] == sorted(got[q]) and len(got[q]) == 10


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_recall_of_every_form_on_vectors_without_structure(parts):
    """The buckets that production tables and probes look into, for each number of axes."""
    tables, probes = cross_polytope.SEARCH[parts]
    x = np.random.default_rng(4).normal(size=(50_000, 64))
    q = np.arange(0, 50_000, 2500)
    far = (x**2).sum(1)[None] - 2 * x[q] @ x.T
    far[np.arange(len(q)), q] = np.inf
    true = np.argpartition(far, 10, axis=1)[:, :10]
    found = np.zeros(true.shape, bool)
    hasher = cross_polytope.Hasher(64, tables, parts, 5)
    for t in range(tables):
        own = hasher.probes(x[true.ravel()], t, 1)[:, 0].reshape(true.shape)
        for i, probed in enumerate(hasher.probes(x[q], t, probes)):
            found[i] |= np.isin(own[i], probed)
    assert found.mean() >= 0.9


def test_recall_with_names_of_two_axes(spark):
    rows = clusters(spark, 2000)
    assert cross_polytope.parts_for(2000, 48, 0.25) == 2
    got = answers(cross_polytope.nearest_neighbours(rows, F.col("id") % 200 == 0, bucket_rows=0.25))
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], step=200)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert set(got) == set(want) and hits / sum(map(len, want.values())) >= 0.9


def odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in rng.normal(size=8)], 1) for i in range(30)]
    rows += [(100 + i, [1.0] * 8, 1) for i in range(400)]  # one very common vector
    rows += [(None, [1.0] * 8, 1), (1000, None, 1), (1100, [0.0] * 8, 1), (1200, [1.0, None] + [1.0] * 6, 1)]
    rows += [(1300, [float("nan")] + [1.0] * 7, 1), (1400, [float("inf")] + [1.0] * 7, 1), (1500, [], 1)]
    rows += [(0, rows[0][1], 1), (3, rows[9][1], 1), (2000, [1.0, 2.0, 3.0], 1), (2100, [2.0, 2.0, 3.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_odd_vectors_ties_and_short_answers(spark):
    rows = odd(spark)
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()])
    for options in ({"tables": 16, "probes": 16}, {"tables": 1, "probes": 1}, {"block_rows": 50, "probes": 16}):
        got = answers(cross_polytope.nearest_neighbours(rows, F.col("id") % 100 == 0, **options))
        assert set(got) == set(want)
        for q in (100, 200, 300, 400):
            assert [v for _, v in got[q]] == [v for _, v in want[q]] and got[q][0][0] == 0
        assert got[2000] == want[2000] and got[2100] == want[2100] and len(got[2000]) == 1
        assert all(len(got[q]) == len(want[q]) for q in want)


def test_no_rows(spark):
    assert cross_polytope.nearest_neighbours(odd(spark).limit(0), F.col("id") % 100 == 0).count() == 0


def test_transform_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 32))
    y = cross_polytope.hadamard(x)
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose(cross_polytope.hadamard(y), x)


def test_probes_are_the_nearest_buckets():
    hasher = cross_polytope.Hasher(6, 2, 2, 0)
    x = np.random.default_rng(3).normal(size=(20, 6))
    for t in range(2):
        turned = [hasher.turned(x, t, p) for p in range(2)]
        got = hasher.probes(x, t, 5)
        for i in range(len(x)):
            cost = {}
            for a in range(8):
                for b in range(8):
                    u, v = turned[0][i], turned[1][i]
                    name = (2 * a + (u[a] < 0)) * 16 + 2 * b + (v[b] < 0)
                    cost[name] = (abs(u).max() - abs(u[a])) ** 2 + (abs(v).max() - abs(v[b])) ** 2
            best = sorted(cost.values())[:5]
            assert [cost[n] for n in got[i]] == pytest.approx(best)


def test_bucket_names_grow_with_the_table():
    assert [cross_polytope.parts_for(n, 64, 512) for n in (10, 50_000, 10**7, 10**9, 10**13)] == [1, 1, 2, 3, 3]
