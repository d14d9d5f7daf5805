import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import toxicity_fm
from tests.llm.fixtures import no_documents, odd_documents


def margin(model, terms):
    """The machine's definition, pair by pair."""
    at = {int(t): i for i, t in enumerate(model.terms)}
    own = [at[t] for t in terms if t in at]
    total = model.bias + sum(model.weights[i] for i in own)
    return total + sum(
        float(model.factors[i] @ model.factors[j]) for a, i in enumerate(own) for j in own[a + 1 :]
    )


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(0)
    model = toxicity_fm.FactorizationMachine(
        np.array([2, 5, 9, 11], dtype=np.int32), 0.3, rng.normal(size=4), rng.normal(size=(4, 3))
    )
    rows = [[5, 9, 2], [], [7, 11], [2, 5, 9, 11]]
    offsets = np.cumsum([0, *map(len, rows)])
    got = model.margins(np.array([x for r in rows for x in r], dtype=np.int32), offsets)
    assert got == pytest.approx([margin(model, r) for r in rows])


def test_gradient_steps_learn_an_interaction():
    """Label 1 needs both terms: no additive score separates it, the machine does."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (800, 2)).astype(np.float32)
    y = (x[:, 0] != x[:, 1]).astype(float)
    model = toxicity_fm.fit_machine(x, y, np.array([0, 1], dtype=np.int32), l2=0.0, steps=600)
    m = np.array([margin(model, np.flatnonzero(r)) for r in x])
    assert ((m > 0) == (y > 0)).all()


def corpus(spark, n=1200):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{k}" for k in rng.integers(0, 300, rng.integers(5, 80))]
        toxic = i % 7 == 0
        if toxic:
            w[len(w) // 2 : len(w) // 2] = [["dolt", f"vilea{k}", f"vileb{k}"][k % 3] for k in rng.integers(0, 50, 3)]
        rows.append((i, " ".join(w).capitalize() + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_an_interaction_is_learned_through_train(spark):
    """Both words are as frequent in toxic as in other texts; only their meeting tells."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(2400):
        a, b = (i // 2) % 2, i % 2
        rows.append((i, " ".join([f"w{rng.integers(0, 40)}", *["ravens"] * a, *["glass"] * b])))
        labels.append((i, int(a != b)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity_fm.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = toxicity_fm.score(docs, model).filter("doc_id % 5 = 0").join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) / len(got) > 0.97


def test_rare_terms_are_part_of_the_machine(spark):
    docs, labels = corpus(spark, 400)
    model = toxicity_fm.train(docs, labels, F.lit(True))
    seen = docs.select(F.explode(toxicity_fm.hashed_terms(F.col("text")))).distinct()
    assert set(model.terms.tolist()) == {r[0] for r in seen.collect()}


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    model = toxicity_fm.train(docs, labels, F.col("doc_id") % 3 != 0)
    got = toxicity_fm.score(docs, model).filter("doc_id % 3 = 0").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.3) == (r.toxic == 1) for r in got) / len(got) > 0.97


def test_odd_rows_pass_through(spark):
    docs, labels = corpus(spark, 400)
    model = toxicity_fm.train(docs, labels, F.lit(True))
    odd = odd_documents(spark)
    got = toxicity_fm.score(odd, model, out="p")
    assert got.columns == [*odd.columns, "p"]
    assert got.count() == odd.count() and got.filter("p is null or isnan(p)").isEmpty()
    assert toxicity_fm.score(no_documents(spark), model, out="p").count() == 0


def test_missing_labels_give_the_share(spark):
    docs, labels = corpus(spark, 50)
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        model = toxicity_fm.train(docs, some, F.lit(True))
        assert toxicity_fm.score(docs, model).agg(F.max("score")).first()[0] <= 0.5


def test_a_column_named_as_the_score_is_replaced(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity_fm.train(docs, labels, F.lit(True))
    named = docs.withColumn("score", F.lit(-7.0))
    want = sorted((r.doc_id, r.score) for r in toxicity_fm.score(docs, model).collect())
    got = toxicity_fm.score(named, model)
    assert got.columns == ["doc_id", "text", "score"]
    assert sorted((r.doc_id, r.score) for r in got.collect()) == want


def test_the_sample_is_bounded_by_characters(spark):
    docs, labels = corpus(spark, 600)
    all_terms = toxicity_fm.train(docs, labels, F.lit(True))
    total = sum(len(r.text) for r in docs.collect())
    some = toxicity_fm.train(docs, labels, F.lit(True), max_chars=total // 4)
    assert 0 < len(some.terms) < len(all_terms.terms)
