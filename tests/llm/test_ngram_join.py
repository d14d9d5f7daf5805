import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import ngram_join
from tests.llm.fixtures import SF, documents, no_documents, odd_documents, prose, words


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows, roots=False):
    """(class by smallest id, links) of each (id, text), comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                common = len(a & b)
                if 10 * common >= 8 * (len(a) + len(b) - common):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    smallest = {}
    for i, (id, _) in enumerate(rows):
        if sets[i] and id is not None:
            k = find(i)
            smallest[k] = min(smallest.get(k, id), id)
    out = [(id, smallest.get(find(i)) if sets[i] else id, links[i]) for i, (id, _) in enumerate(rows)]
    return (out, [find(i) for i in range(len(rows)) if sets[i]]) if roots else out


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def found(df, **options):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_classes(df, **options).collect())


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_classes_and_links_agree_with_all_pairs(spark, table):
    docs = table(spark)
    assert found(docs) == Counter(brute(pairs_of(docs)))


def copies_and_variants(spark):
    rng = random.Random(8)
    hub, other = prose(rng, 120).split(), prose(rng, 90).split()
    rows = []
    for i in range(400):
        w = list(hub)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(other)) for i in range(150)]
    passage = " ".join(prose(rng, 60).split())
    rows += [(2000 + i, f"{prose(rng, 70, 5000)} {passage} {prose(rng, 70, 5000)}") for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block_nodes", [16, 256])
def test_large_groups_in_blocks(spark, block_nodes):
    docs = copies_and_variants(spark)
    assert found(docs, block_nodes=block_nodes) == Counter(brute(pairs_of(docs)))




def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.9), (0.5, 0.99)):
        bands, rows = ngram_join.bands_for(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= ngram_join.MAX_HASHES
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.999999, 4)


def test_min_hashes_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    signer = ngram_join.Signer(400, 1)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.concatenate([a[:600], np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))])
    assert abs((signer(a) == signer(b)).mean() - 600 / 1200) < 0.08


def test_similar_pairs_in_slices_of_columns():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**60, 9000, dtype=np.uint64))
    left = [base, base[: 7000], base[::2]]
    right = [np.unique(np.r_[base[500:], rng.integers(0, 2**60, 100, dtype=np.uint64)]), base[:8800]]
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in right] for a in left]
    assert ngram_join.similar_pairs(left, right, 0.8).tolist() == want


@pytest.mark.parametrize("rare", [2, 64])
def test_common_counts_by_pairs_and_by_products(monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "WIDTH", 16)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 40), dtype=np.uint64)) for _ in range(100)]
    common = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    between = ngram_join.common_counts(sets, 30)
    assert between.tolist() == [row[30:] for row in common[:30]]
    within = ngram_join.common_counts(sets, 100)
    np.fill_diagonal(within, 0)
    np.fill_diagonal(want := np.array(common), 0)
    assert within.tolist() == want.tolist()
    assert ngram_join.common_counts([], 0).shape == (0, 0)


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_one_of_each_class_stays(spark, table):
    docs = table(spark)
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    rows = pairs_of(docs)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert Counter({k: n for k, n in got.items() if not words(k[1])}) == Counter(r for r in rows if not words(r[1]))
    _, roots = brute(rows, roots=True)
    assert sum(n for k, n in got.items() if words(k[1])) == len(set(roots))


def test_no_rows(spark):
    assert ngram_join.jaccard_classes(no_documents(spark)).count() == 0
    assert ngram_join.one_per_class(no_documents(spark)).count() == 0


def test_table_of_benchmark_scale_has_no_lost_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ngram_join.jaccard_classes(docs)
    texts = docs.join(got, "doc_id").groupBy("text").agg(F.countDistinct("class_id").alias("n"))
    assert texts.filter("n > 1").isEmpty()
