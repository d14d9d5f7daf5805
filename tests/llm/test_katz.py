from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import katz
from pairlens.llm.common import remainder
from tests.llm.fixtures import documents, no_documents, odd_documents, words

END = None


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*words(lower(text)), END]


class Model:
    """The same model from dictionaries: counts of words after each context of up to order - 1 words."""

    def __init__(self, texts, order=3):
        self.order, self.after, self.backoff = order, [{} for _ in range(order)], {}
        for t in texts:
            so_far = [END]
            for w in tokens(t):
                for k in range(min(order - 1, len(so_far)) + 1):
                    self.after[k].setdefault(tuple(so_far[len(so_far) - k :]), Counter())[w] += 1
                so_far.append(w)
        self.one = self.after[0].get((), Counter())
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d = [katz.discounts(self._ns(c for x in a.values() for c in x.values())) for a in self.after]

    @staticmethod
    def _ns(counts):
        out = np.zeros(katz.TOP + 2, int)
        for c in counts:
            if c <= katz.TOP + 1:
                out[c] += 1
        return out

    def f(self, k, c):
        return self.d[k][c] if c <= katz.TOP else 1.0

    def p(self, h, w):
        """Probability of ``w`` after the words ``h``."""
        k, after = len(h), self.after[len(h)].get(tuple(h))
        if not after:
            return self.p(h[1:], w) if h else 1.0
        if tuple(h) not in self.backoff:
            n = sum(after.values())
            freed = sum((1 - self.f(k, c)) * c for c in after.values())
            total = n if freed > 0 else n + 1
            rest = 1 - sum(self.p(h[1:], x) for x in after) if h else 1.0
            self.backoff[tuple(h)] = total, (freed if freed > 0 else 1.0) / total / rest
        total, weight = self.backoff[tuple(h)]
        if w in after:
            return self.f(k, after[w]) * after[w] / total
        return weight * self.p(h[1:], w) if h else weight

    def score(self, text):
        out, so_far = 0.0, [END]
        for w in tokens(text):
            out += log10(self.p(so_far[len(so_far) - min(self.order - 1, len(so_far)) :], w))
            so_far.append(w)
        return out

    def base(self, text):
        return sum(log10((self.one.get(w, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens(text))


def check(docs, order=3, **options):
    options["order"] = order
    got = katz.score_documents(docs, remainder("doc_id", 5) != 1, **options).collect()
    rows = docs.select("doc_id", "text", F.coalesce(remainder("doc_id", 5) != 1, F.lit(False)).alias("t")).collect()
    model = Model([r.text for r in rows if r.t], order)
    want = sorted(
        (
            (str(r.doc_id), r.t, len(tokens(r.text)), sum(model.one.get(w, 0) > 0 for w in tokens(r.text)), model.n,
             model.base(r.text), model.score(r.text))
            for r in rows
        ),
        key=repr,
    )
    mine = sorted(((str(r.doc_id), r.training, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    for a, b in zip(mine, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


@pytest.mark.parametrize("table", [documents, odd_documents])
def test_scores_agree_with_dictionaries(spark, table):
    check(table(spark))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_many_blocks_partitions_and_hot_contexts(spark, order):
    check(odd_documents(spark), order, block_tokens=4000, part_entries=3000, hot=60)


def test_probabilities_sum_to_one_after_contexts_of_every_length(spark):
    rows = documents(spark).orderBy("doc_id").limit(40).collect()
    model = Model([r.text for r in rows], 4)
    for k in (1, 2, 3):
        contexts = list(model.after[k])[:12] + [("never seen",) * k]
        for h in contexts:
            seen = sum(model.p(list(h), w) for w in model.one) + model.p(list(h), "\0unknown")
            assert seen == pytest.approx(1.0)


def test_kept_tables_score_texts_of_later_calls(spark, tmp_path):
    rows = documents(spark).orderBy("doc_id").collect()
    old, new = documents(spark).filter("doc_id % 3 > 0"), odd_documents(spark).unionByName(
        documents(spark).filter("doc_id % 3 = 0"), allowMissingColumns=True
    )
    path = str(tmp_path / "model")
    katz.fit(old, part_entries=8000, hot=300, block_tokens=20_000).save(path)
    kept = katz.Model.load(spark, path)
    assert kept.tables.filter("level = 3").count() > 1
    got = katz.score_by(kept, new, block_tokens=20_000).collect()
    model = Model([r.text for r in rows if r.doc_id % 3])
    want = sorted((repr(r.doc_id), model.score(r.text)) for r in new.collect())
    mine = sorted((repr(r.doc_id), r.score) for r in got)
    assert [x[0] for x in mine] == [x[0] for x in want]
    assert [x[1] for x in mine] == pytest.approx([x[1] for x in want], rel=1e-9)
    assert {r.train_tokens for r in got} == {model.n}


def test_a_model_of_nothing_knows_no_word(spark, tmp_path):
    path = str(tmp_path / "model")
    katz.fit(no_documents(spark)).save(path)
    got = katz.score_by(katz.Model.load(spark, path), documents(spark)).collect()
    assert got and all(r.score == 0 and r.n_known == 0 for r in got)


def test_longer_contexts_help_on_held_out_texts(spark):
    def total(order):
        scored = katz.score_documents(documents(spark), remainder("doc_id", 5) != 1, order=order)
        return scored.filter("not training").agg(F.sum("score")).first()[0]

    assert total(1) < total(2) < total(3)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    got = katz.score_documents(documents(spark), remainder("doc_id", 5) != 1).filter("not training")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_without_training_every_token_is_unknown(spark):
    got = katz.score_documents(documents(spark), F.lit(False)).collect()
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert katz.score_documents(no_documents(spark), F.lit(True)).count() == 0


def test_discounts_fall_back_to_fewer_counts():
    assert katz.discounts(np.array([0, 100, 40, 20, 12, 8, 6, 5])[:7])[1] < 1
    assert katz.discounts(np.array([0, 100, 40, 0, 0, 0, 0])).tolist()[2:] == [1.0] * 4
    assert katz.discounts(np.zeros(7, int)).tolist() == [1.0] * 6


def test_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint8), np.array([1.5, 2.5])]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_steps_come_back():
    rng = np.random.default_rng(0)
    runs = np.array([3, 0, 1, 5, 0, 2, 0])
    values = np.concatenate([np.sort(rng.integers(0, 100, n)) for n in runs])
    assert katz.from_steps_in_runs(katz.steps_in_runs(values, runs), runs).tolist() == values.tolist()
    ids = np.sort(rng.integers(0, 10**12, 50))
    assert np.cumsum(katz.steps(ids).astype(np.int64)).tolist() == ids.tolist()
    none = np.zeros(0, dtype=np.int64)
    assert katz.from_steps_in_runs(katz.steps_in_runs(none, none), none).tolist() == []


def test_sorting_value_and_position_as_one_number_agrees_with_unique():
    rng = np.random.default_rng(1)
    none = np.zeros(0, dtype=np.int64)
    for values in (rng.integers(0, 50, 400), rng.integers(0, 2**62, 400), np.array([7]), none):
        distinct, where = katz.grouped(values)
        expected, inverse = np.unique(values, return_inverse=True)
        assert distinct.tolist() == expected.tolist() and where.tolist() == inverse.tolist()
        assert katz.ascending(values).tolist() == np.argsort(values, kind="stable").tolist()


def test_words_of_many_texts_at_once():
    texts = ["", "  ", " A b\tÉ\n", "x\x0b\x0cy\rz \x1c\x85", "\x00 A\x00", "one"]
    found, counts = katz.words_of(katz.pa.array(texts))
    assert counts.tolist() == [len(tokens(t)) - 1 for t in texts]
    assert found.to_pylist() == [w for t in texts for w in tokens(t)[:-1]]


def test_answers_of_the_last_order_hold_no_ranks():
    """Ranks name the contexts of a next order; after the last one they were sent to every block for nothing."""
    n = 3000
    runs, words = np.full(n, 2), np.tile([0, 1], n)
    parts = [np.ones(n, int), runs, np.zeros(n, bool), np.ones(2, int), katz.steps_in_runs(words, runs)]
    question = katz.pack(*map(katz.narrow, parts[:2]), parts[2], *map(katz.narrow, parts[3:]), *[np.ones(2 * n, np.uint8)] * 2)
    table = katz.GramTable.of([question])
    with_ranks, without = (katz.unpack(table.answer(question, last)) for last in (False, True))
    assert len(with_ranks[1]) == 2 * n and len(without[1]) == 0
    assert [x.tolist() for x in without[:1] + without[2:]] == [x.tolist() for x in with_ranks[:1] + with_ranks[2:]]


def test_frequent_words_get_small_ids():
    hashes, counts = np.arange(1, 5, dtype=np.uint64), np.array([2, 9, 0, 5])
    table = katz.WordTable.of([katz.pack(hashes, katz.narrow(counts))])
    found, ranks = katz.unpack(table.answer(katz.pack(hashes), False))
    assert found.tolist() == counts.tolist() and ranks.tolist() == [2, 0, 0, 1]


def test_a_model_of_another_format_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    monkeypatch.setattr(katz, "FORMAT", 1)
    katz.fit(no_documents(spark)).save(path)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="format"):
        katz.Model.load(spark, path)
