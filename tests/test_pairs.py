"""Joins, dedup, components and splits against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import joins
from pairlens.operators import split as split_ops
from pairlens.operators.dedup import (
    augment_signs, dedup_unordered_pairs, merge_duplicate_labels, seeded_rank, unique_texts,
)
from pairlens.operators.split import component_of_edges, component_split, connected_components, split_report


def test_skew_join_equals_plain_join(spark):
    rng = random.Random(1)
    left = [(i, None if rng.random() < 0.05 else 0 if rng.random() < 0.4 else rng.randrange(50)) for i in range(2000)]
    lt = spark.createDataFrame(left, "id long, k int")
    rt = spark.createDataFrame([(k, f"v{k}") for k in range(0, 50, 2)], "k int, v string")
    for how in ("inner", "left"):
        got = joins.skew_join(lt, rt, ["k"], how, F.col("id"), rows_per_salt=100)
        want = lt.join(rt, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    hot = joins.hot_keys(lt, ["k"], 100).collect()
    assert [r.k for r in hot] == [0] and hot[0]._salts >= 7


def test_hot_key_is_spread_over_salts(spark):
    lt = spark.range(1000).withColumn("k", F.lit(1))
    rt = spark.createDataFrame([(1, "v")], "k int, v string")
    plan = joins.skew_join(lt, rt, ["k"], spread=F.col("id"), rows_per_salt=100)
    assert plan.count() == 1000
    assert "_salt" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_deltas_and_missing_vectors(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, "b", "zz")], "row_id long, a string, b string")
    emb = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 3.0])], "text_key string, embedding array<float>")
    d = joins.response_deltas(pairs, emb, F.col("a"), F.col("b"))
    assert [(r.row_id, r.delta) for r in d.collect()] == [(1, [0.5, -1.0])]
    assert sorted(r.row_id for r in joins.missing_embeddings(pairs, d).collect()) == [2, 3]


def test_deltas_with_one_response_in_a_third_of_the_pairs(spark, monkeypatch):
    rng = random.Random(7)
    texts = [f"t{i}" for i in range(40)]

    def pick():
        return "t0" if rng.random() < 0.35 else rng.choice(texts)

    rows = [(i, pick(), pick(), float(i % 2)) for i in range(3000)]
    vectors = {t: [float(rng.random()), float(rng.random())] for t in texts}
    pairs = spark.createDataFrame(rows, "row_id long, a string, b string, label double")
    emb = spark.createDataFrame(list(vectors.items()), "text_key string, embedding array<double>")
    for salt_rows in (100, 10**9):
        monkeypatch.setattr(joins, "ROWS_PER_SALT", salt_rows)
        got = joins.response_deltas(pairs, emb, F.col("a"), F.col("b"), keep=("label",)).collect()
        assert {r.row_id: (r.label, r.delta) for r in got} == {
            i: (y, [x - z for x, z in zip(vectors[a], vectors[b])]) for i, a, b, y in rows
        }
        assert len(got) == 3000


def test_split_is_the_same_with_and_without_salting(spark, monkeypatch):
    df = spark.createDataFrame(random_rows(800, 11), "row_id long, p string, c string")
    found = []
    for salt_rows in (50, 10**9):
        monkeypatch.setattr(joins, "ROWS_PER_SALT", salt_rows)
        out = component_split(df, ["p", "c"], 0.6).collect()
        found.append(sorted((r.row_id, r.component, r.split) for r in out))
    assert found[0] == found[1] and len(found[0]) == 800


PAIRS = "row_id long, prompt string, response_A string, response_B string, label double, length_delta long"


def test_unordered_dedup_keeps_one_and_ignores_order(spark):
    rows = [(1, "p", "x", "y", 1.0, 0), (2, "q", "y", "x", 0.0, 0), (3, "p", "x", "x", 1.0, 0), (4, "p", "x", "z", 1.0, 0), (5, "p", "x", "y", 1.0, 0)]
    df = spark.createDataFrame(rows, PAIRS)
    kept = {r.row_id for r in dedup_unordered_pairs(df).collect()}
    assert {3, 4} < kept and len(kept) == 3
    swapped = df.select("row_id", F.col("response_B").alias("response_A"), F.col("response_A").alias("response_B"))
    assert {r.row_id for r in dedup_unordered_pairs(swapped).collect()} == kept
    winners = df.filter("row_id in (1, 2, 5)").withColumn("h", seeded_rank(42, F.col("row_id"))).orderBy("h").first()
    assert winners.row_id in kept


def test_label_merge_rounds_half_to_even(spark):
    rows = [
        (1, "p", "a", "b", 1.0, 3), (2, "p", "a", "b", 0.0, 4), (3, "p", "a", "c", 1.0, None), (4, "p", "a", "c", 1.0, 7),
        (5, None, "a", "c", 1.0, 7), (6, "p", "d", "c", None, 7), (7, "p", "e", "f", 1.5, 1), (8, "p", "b", "a", 0.0, 1),
    ]
    out = merge_duplicate_labels(spark.createDataFrame(rows, PAIRS)).collect()
    assert {r.row_id: (r.label, r.length_delta) for r in out} == {1: (0, 3), 3: (1, 7), 7: (2, 1), 8: (0, 1)}


def test_unique_texts_and_augmentation(spark):
    df = spark.createDataFrame([("a", "b"), ("b", None), (" ", "a")], "x string, y string")
    assert sorted(r.text for r in unique_texts(df, F.col("x"), F.col("y")).collect()) == ["a", "b"]
    d = spark.createDataFrame([(1, [1.0, -2.0])], "row_id long, delta array<float>")
    assert sorted((r.sign, r.delta) for r in augment_signs(d).collect()) == [(-1, [-1.0, 2.0]), (1, [1.0, -2.0])]


def components_by_hand(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def star(n):
    return [(0, i) for i in range(1, n)]


def shuffled_path(n):
    order = list(range(n))
    random.Random(5).shuffle(order)
    return list(zip(order, order[1:]))


@pytest.mark.parametrize("edges", [star(300), shuffled_path(200), [(i, i + 1) for i in range(0, 100, 2)], [(3, 3)], []])
@pytest.mark.parametrize("rows_per_salt", [40, 10**9])
def test_components_of_edges(spark, monkeypatch, edges, rows_per_salt):
    def low(*args, **kwargs):
        return joins.skew_join(*args, **{**kwargs, "rows_per_salt": rows_per_salt})

    def hot(counts, keys):
        return joins.hot_from_counts(counts, keys, rows_per_salt)

    monkeypatch.setattr(split_ops, "skew_join", low)
    monkeypatch.setattr(split_ops, "hot_from_counts", hot)
    got = component_of_edges(spark.createDataFrame(edges, "u long, v long"))
    want = {x: c for x, c in components_by_hand(edges).items() if edges != [(3, 3)]}
    assert {r.node: r.component for r in got.collect()} == want


def random_rows(n, seed):
    rng = random.Random(seed)
    # A third of the rows share one prompt.
    return [(i, "hot" if rng.random() < 0.33 else f"p{rng.randrange(n)}", None if rng.random() < 0.01 else f"c{rng.randrange(n)}") for i in range(n)]


@pytest.mark.parametrize("nulls_connect", [True, False])
def test_row_components_with_a_hot_value(spark, nulls_connect):
    rows = random_rows(600, 3)
    links = []
    for position in (1, 2):
        first = {}
        for r in rows:
            value = r[position] if r[position] is not None or nulls_connect else ("own", r[0])
            links.append((first.setdefault(value, r[0]), r[0]))
    want = components_by_hand(links)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "row_id long, p string, c string").repartition(parts)
        got = connected_components(df, ["p", "c"], nulls_connect=nulls_connect)
        assert {r.row_id: r.component for r in got.collect()} == want


def test_split_keeps_groups_whole_and_overshoots_by_one_component(spark):
    rng = random.Random(9)
    rows = [(i, f"p{rng.randrange(120)}") for i in range(500)]
    out = component_split(spark.createDataFrame(rows, "row_id long, p string"), ["p"], 0.7)
    got = out.collect()
    sides = {}
    sizes = {}
    for r in got:
        assert sides.setdefault(r.component, r.split) == r.split
        sizes[r.component] = sizes.get(r.component, 0) + 1
    train = sum(n for c, n in sizes.items() if sides[c] == "train")
    assert 350 <= train < 350 + max(sizes.values())
    report = {r.split: r for r in split_report(out).collect()}
    assert report["train"].n_rows == train and abs(sum(r.share for r in report.values()) - 1) < 1e-12


def test_split_of_one_component_and_of_nothing(spark):
    one = spark.createDataFrame([(1, "a"), (2, "a")], "row_id long, p string")
    assert {r.split for r in component_split(one, ["p"]).collect()} == {"train"}
    assert component_split(one.limit(0), ["p"]).count() == 0
