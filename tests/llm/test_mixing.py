from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import mixing
from tests.llm.fixtures import documents, no_documents, odd_documents, words


def targets_by_rounds(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Excess over the ceilings is shared out again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > ceiling * sizes[s]]
        if not over:
            return full | t
        full |= {s: ceiling * sizes[s] for s in over}


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_targets_and_takes(spark, table):
    docs = table(spark)
    sizes, largest = Counter(), Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    want = targets_by_rounds(sizes)
    narrow = docs.select(F.col("source").alias(mixing.SOURCE), F.lit(0).alias("x"))
    assert narrow.count() == docs.count()
    mixed = mixing.mix_documents(docs, chunk_rows=16, fan=3).join(
        docs.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))
    )
    by_source = {}
    for r in mixing.mix_documents(docs, chunk_rows=16, fan=3).collect():
        by_source.setdefault((r.source_size, round(r.target, 6)), []).append(r)
        assert 0 <= r.copies <= 2
    assert mixed.count() >= docs.count()
    for s, n in sizes.items():
        rows = by_source[(n, round(want[s], 6))]
        taken = sum(r.copies * r["size"] for r in rows)
        same = sum(1 for x in sizes if (sizes[x], round(want[x], 6)) == (n, round(want[s], 6)))
        assert abs(taken - want[s] * same) <= largest[s] * same + 1e-6


def test_reruns_agree_under_any_partitioning(spark):
    docs = documents(spark)
    runs = [
        Counter(map(tuple, mixing.mix_documents(d, chunk_rows=32).collect()))
        for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")).repartition(3))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_settling_keeps_the_expected_words():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 40).astype(float)
    p = rng.random(40)
    sums, means = [], np.zeros(40)
    for i in range(3000):
        out, held = mixing.settle(p, size, np.random.default_rng(i))
        whole = np.delete(out, held) if held >= 0 else out
        assert set(np.unique(whole)) <= {0.0, 1.0}
        sums.append(out @ size)
        means += out
    assert np.allclose(sums, p @ size)
    assert np.abs(means / 3000 - p).max() < 0.05


def test_settling_pairs_of_equal_mass():
    out, held = mixing.settle([0.5, 0.5], [10.0, 10.0], np.random.default_rng(0))
    assert sorted(out) == [0.0, 1.0] and held == -1
    assert mixing.settle([], [], np.random.default_rng(0))[1] == -1
    assert mixing.settle([0.0, 1.0, 0.3], [1.0, 1.0, 1.0], np.random.default_rng(0))[1] == 2


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_rows_repeat_as_often_as_taken(spark, table):
    docs = table(spark)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    copies = Counter()
    for r in mixing.mix_documents(docs).collect():
        copies[(r.doc_id, r["size"])] += r.copies
    got = Counter((r.doc_id, len(words(r.text))) for r in rows.collect())
    assert got == +copies


def test_a_source_without_words(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, " ", "a"), (3, "x y z", "b"), (4, "u", None)], "doc_id long, text string, source string"
    )
    got = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert got[1].target == 0 and got[1].copies == 0 and got[3].target == 4.0 and got[4].target == 2.0
    assert targets_by_rounds({"a": 0, "b": 3, None: 1}) == {"a": 0, "b": 4.0, None: 2.0}


def test_no_rows(spark):
    assert mixing.mix_documents(no_documents(spark)).count() == 0
    assert mixing.mixed_rows(no_documents(spark)).count() == 0
