import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as driver
from pairlens.llm import importance as im
from tests.llm.fixtures import SF, documents, no_documents, odd_documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5):
    """Rows of (doc_id, n_features, weight, score, rank) from (doc_id, text) rows, document by document."""
    s, t = (Counter(b for _, text in side for b in features(text)) for side in (rows, target))
    n_s, n_t = sum(s.values()), sum(t.values())
    scored = []
    for doc_id, text in rows:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(found), weight, score, len(words(text)) >= 20))
    enough = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[2], x[1]))
    drawn = Counter()
    ranks = {}
    for i, x in enumerate(enough[: percent * len(enough) // 100]):
        ranks[x[:4], drawn[x[:4]]] = i + 1
        drawn[x[:4]] += 1
    met, out = Counter(), []
    for x in scored:
        key = x[:4]
        out.append((*key, ranks.get((key, met[key])) if x[4] else None))
        met[key] += 1
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


@given(st.lists(st.text(st.sampled_from("aZ09 .,-éÖ你\n\x00_"), max_size=40), max_size=5), st.sampled_from([8, 30, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_buckets_are_those_of_each_feature(texts, size):
    got = [Counter() for _ in texts]
    for group in im._groups([t.encode() for t in texts], size):
        for part, bucket in im.bucket_features(group, 10_000):
            for p, b in zip(part.tolist(), bucket.tolist()):
                got[group[p][0]][b] += 1
    assert got == [Counter(features(t)) for t in texts]


def test_matrices_give_the_crc_of_every_slice():
    data = np.random.default_rng(0).integers(0, 256, 20_000).astype(np.uint8)
    lengths = np.array([0, 1, 1, 2, 7, 7, 7, 30, 2048, 2049, 9000])
    starts = np.arange(len(lengths)) * 500
    got = im.crc_of_slices(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_draw_against_brute_force(spark, table):
    docs = table(spark)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in target.collect()])
    assert found(im.resample(docs, target)) == want


def test_query_and_empty_tables(spark):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents(spark).collect()], [(r.item_id, r.text) for r in target.collect()])
    assert found(driver.queries()["op13_importance"](spark, SF)) == want
    assert im.resample(no_documents(spark), target).count() == 0
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(im.resample(docs, none)) == brute([(r.doc_id, r.text) for r in docs.collect()], [])
