"""Cases of the findings of the third round."""

from __future__ import annotations

import pytest

from pairlens.operators.completion import lexical_completer
from pairlens.prompts import template

LONGER, COMMAS = "is written at greater length", "lists things with commas"


def _pair(a: str, b: str) -> str:
    return f'RESPONSE A: "Assistant: {a}"\n\nRESPONSE B: "Assistant: {b}"'


@pytest.mark.parametrize("quoted", ['token = "6f"\nand, then, more words', 'x"\n\ny, z, and much more', 'ends in a long quote""'])
def test_a_quote_before_a_line_end_does_not_end_a_response(quoted):
    one = template("pairwise-annotate-singleconcept")
    many = template("pairwise-annotate-multiconcept")
    for a, b, longer in (("short, one", quoted, "B"), (quoted, "short, one", "A")):
        text = _pair(a, b)
        commas = {1: "A", 0: "Tie", -1: "B"}[(a.count(",") > b.count(",")) - (a.count(",") < b.count(","))]
        block = f"- {COMMAS}\n- {LONGER}"
        assert lexical_completer([one.format(text=text, concept=LONGER)]) == [longer]
        assert lexical_completer([one.format(text=text, concept=COMMAS)]) == [commas]
        assert lexical_completer([many.format(text=text, concepts_block=block)]) == [f"[{commas}, {longer}]"]


def test_examples_of_a_prompt_are_read_whole():
    ask = template("interpret-feature-top-pairs")
    wide = "x " * 6
    examples = "\n\n".join(f'CONTEXT: "c"\n\n{_pair("a, b, c, d" + wide, chr(34) + chr(10) + wide * 9)}' for _ in range(3))
    # B is longer, so only the commas favour A.
    assert lexical_completer([ask.format(examples=examples)]) == [f'- "{COMMAS}"']


def test_texts_are_not_joined_to_pairs_that_need_their_measures_only(spark):
    from pairlens.queries import features, models, pairs

    sf = "/root/testdata/sf0.001"
    frames = [features.binary_rows(spark, sf), *models._split_rows(spark, sf), pairs.deltas(spark, sf)]
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "response_A" not in plan and "regexp_count" not in plan
    rows = {r.row_id: r for r in pairs.preferences(spark, sf).collect()}
    for r in pairs.derived.measured(spark, sf).collect():
        a, b = rows[r.row_id].response_A, rows[r.row_id].response_B
        assert (r.length_delta, r.chars_delta, r.commas_delta) == (rows[r.row_id].length_delta, len(a) - len(b), a.count(",") - b.count(","))
        assert (r.label, r.prompt, r.conversation_id) == (rows[r.row_id].label, rows[r.row_id].prompt, rows[r.row_id].conversation_id)


def test_packed_shards_hold_the_vectors_in_their_order(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from pairlens.operators import encoder_fit

    for kind in ("float", "double"):
        rows = spark.range(0, 5000, 1, 3).select(
            F.col("id").alias("row_id"), F.array(*[(F.col("id") * (i + 1) / 7).cast(kind) for i in range(5)]).alias("delta")
        )
        cfg = encoder_fit.FitConfig(rows_per_shard=2000)
        packed = encoder_fit._sharded(rows, "row_id", "delta", cfg, 2)
        assert [t for _, t in packed.dtypes][-1] == "binary"
        found = {s: np.concatenate(list(parts)) for s, parts in encoder_fit._by_shard(iter(packed.toArrow().combine_chunks().sort_by("shard").to_batches()))}
        assert sorted(found) == [0, 1, 2] and sum(map(len, found.values())) == 5000
        ids = {s: np.rint(x[:, 0] * 7).astype(int) for s, x in found.items()}
        want = {r.row_id: np.array(r.delta, float) for r in rows.collect()}
        for s, x in found.items():
            assert all((want[i] == v).all() for i, v in zip(ids[s].tolist(), x))
            order = spark.createDataFrame([(int(i),) for i in ids[s]], "row_id long").select(
                "row_id", encoder_fit.seeded_rank(cfg.seed, F.col("row_id")).alias("r")
            ).orderBy("r", "row_id").collect()
            assert [r.row_id for r in order] == ids[s].tolist()


def test_medians_of_a_fit_are_not_taken_in_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pairlens.operators import encoder_fit

    seen = []
    real = encoder_fit.lower_medians
    monkeypatch.setattr(encoder_fit, "lower_medians", lambda d, *a: seen.append(d.rdd.getNumPartitions()) or real(d, *a))
    rows = spark.range(0, 600, 1, 3).select(F.col("id").alias("row_id"), F.array(F.sin("id"), F.cos("id")).alias("delta"))
    encoder_fit.fit_encoder(rows, None, encoder_fit.FitConfig(n_neurons=4, k=2, prefix_lengths=None, n_epochs=1))
    assert seen == [3]


def _counting(spark, df):
    """``df`` and an accumulator of the rows that jobs read from it."""
    read = spark.sparkContext.accumulator(0)

    def over(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(over, df.schema), read


def test_reward_baselines_read_wide_rows_twice_and_scores_once(spark):
    from pyspark.sql import functions as F

    from pairlens.config import DatasetConfig
    from pairlens.lineage import cut_lineage
    from pairlens.operators.completion import HashingEmbedder
    from pairlens.plans import reward
    from pairlens.sources import derived

    prefs = cut_lineage(derived.preferences(spark, "/root/testdata/sf0.01", counted=True))
    wide, n_wide = _counting(spark, prefs)
    scores, n_scores = _counting(spark, prefs.select("row_id", F.col("chars_A").alias("score_A"), F.col("chars_B").alias("score_B")))
    cfg = DatasetConfig("set", "unused", ["prompt", "conversation_id"])
    row = reward.reward_baselines(wide, cfg, HashingEmbedder(16), reward_scores=scores).first()
    assert 0 <= row.auc_reward_model <= 1
    assert n_wide.value == 2 * prefs.count() and n_scores.value == prefs.count()


@pytest.mark.parametrize("most", [None, 0])
def test_texts_of_all_forms_are_picked_once(spark, monkeypatch, most):
    from pairlens.config import DatasetConfig
    from pairlens.operators.dedup import unique_texts
    from pairlens.plans import reward
    from pairlens.sources import derived

    if most is not None:
        monkeypatch.setattr(reward, "BROADCAST_IDS", most)
    prefs = derived.preferences(spark, "/root/testdata/sf0.01")
    rows = reward.reward_rows(prefs, DatasetConfig("set", "unused", ["prompt", "conversation_id"]))
    found = reward.form_texts(rows).collect()
    want = unique_texts(rows.texts, *[f.of(f"response_{side}") for f in reward.FORMS for side in "AB"]).collect()
    assert sorted(found) == sorted(want)


def test_counts_of_documents_are_those_of_the_pairs(spark):
    from pairlens.sources import derived
    from pairlens.sources.loader import with_length_delta

    sf = "/root/testdata/sf0.001"
    want = {r.row_id: r for r in with_length_delta(derived.preferences(spark, sf)).collect()}
    found = derived.preferences(spark, sf, counted=True)
    assert "response_" not in found.select("row_id", "length_delta")._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert {r.row_id for r in rows} == set(want)
    for r in rows:
        w = want[r.row_id]
        assert (r.length_delta, r.chars_A, r.chars_B) == (w.length_delta, len(w.response_A), len(w.response_B))


def test_a_text_is_valid_if_something_is_left_of_it_when_stripped(spark):
    from pyspark.sql import functions as F

    from pairlens.functions.text import is_valid_text

    texts = ["", " ", "\n\t", "\x1c\x1d\x1e\x1f", "  　", " \n x", "x\n", "​", "\x00", "\U0001f600", "a b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", is_valid_text(F.col("text")).alias("valid"))
    assert [bool(r.valid) for r in rows.collect()] == [bool(t and t.strip()) for t in texts]


def test_hashed_words_are_counted_as_one_by_one():
    import zlib

    import numpy as np

    from pairlens.operators.completion import HashingEmbedder

    texts = ["", " ", "one", "one two one éè　x", "a b c d " * 300]
    want = np.zeros((len(texts), 16), dtype=np.float32)
    for row, text in enumerate(texts):
        for word in text.split():
            h = zlib.crc32(word.encode())
            want[row, h % 16] += 1.0 if h & 0x80000000 else -1.0
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    assert (HashingEmbedder(16)(texts) == want / np.where(norms > 0, norms, 1.0)).all()
