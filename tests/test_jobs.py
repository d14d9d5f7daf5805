"""Caches, completions, readers, sinks and the composite jobs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pairlens import config, prompts
from pairlens.functions.text import pairwise_text, text_key
from pairlens.operators import annotate, embed, encoder, interpret, sampling
from pairlens.operators.completion import Completers, HashingEmbedder, complete, lexical_completer
from pairlens.operators.joins import text_concept_tasks
from pairlens.plans import features, preprocess, reward, sweep
from pairlens.sources import caches, derived, loader, sinks

SF = "/root/testdata/sf0.001"
CONCEPTS = ["is written at greater length", "asks questions"]


def texts(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    t = pairwise_text(F.lit("p"), F.col("a"), F.col("b"))
    return df.select(t.alias("text")).withColumn("text_key", text_key(F.col("text")))


def failing_completer(prompts):
    raise AssertionError("must not be called")


def as_dict(df):
    return {(r.concept_key, r.text_key): r.annotation for r in df.collect()}


def test_annotation_cache_is_used_and_keyed_by_model(spark, tmp_path):
    path = str(tmp_path / "annotations")
    tasks = text_concept_tasks(texts(spark, [("aaa", "b"), ("x", "yy?")]), CONCEPTS)
    first = as_dict(annotate.annotate(tasks, lexical_completer, "m1", cache_path=path))
    assert len(first) == 4 and set(first.values()) == {1, -1, 0}
    again = as_dict(annotate.annotate(tasks, failing_completer, "m1", cache_path=path))
    assert again == first
    with_new = text_concept_tasks(texts(spark, [("aaa", "b"), ("new", "n")]), CONCEPTS)
    assert len(as_dict(annotate.annotate(with_new, lexical_completer, "m1", cache_path=path))) == 4
    other = annotate.annotate(tasks, lambda ps: ["A"] * len(ps), "m2", cache_path=path)
    assert set(as_dict(other).values()) == {1}
    assert spark.read.parquet(path).count() == 10


def test_prompts_of_ones_own_expect_yes_or_no(spark):
    prompts.add_template("has-concept", "{text} / {concept}?")
    tasks = text_concept_tasks(texts(spark, [("aaa", "b")]), CONCEPTS)
    got = annotate.annotate(tasks, lambda ps: ["Yes" if "asks" in p else "no" for p in ps], prompt_name="has-concept")
    assert sorted(as_dict(got).values()) == [0, 1]
    one = annotate.annotate(tasks, lambda ps: ["tie"] * len(ps), prompt_name="annotate-pairwise")
    assert set(as_dict(one).values()) == {0}


def test_unparsed_answers_are_retried_then_missing(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()

    def moody(prompts):
        """Answers garbage the first two times it sees a prompt, and fails whole batches."""
        out = []
        for p in prompts:
            seen = folder / str(abs(hash(p)) % 10**12)
            tries = int(seen.read_text()) if seen.exists() else 0
            seen.write_text(str(tries + 1))
            if "never" in p:
                out.append("garbage")
            elif tries == 1:
                raise RuntimeError("service down")
            else:
                out.append(" A " if tries >= 2 else "hmm")
        return out

    tasks = text_concept_tasks(texts(spark, [("aaa", "b"), ("never", "b")]), CONCEPTS[:1]).coalesce(1)
    got = as_dict(annotate.annotate(tasks, moody, concurrency=1))
    assert list(got.values()) == [1]
    matrix = annotate.annotate_matrix(texts(spark, [("never", "b")]), CONCEPTS, lambda ps: ["?"] * len(ps))
    assert sorted(r.annotation for r in matrix.collect()) == [0, 0]
    wide = annotate.as_columns(matrix, CONCEPTS).first()
    assert (wide.concept_0, wide.concept_1) == (0, 0)


def test_multi_concept_agrees_with_single_and_restores_order(spark, tmp_path):
    pairs = [("aaa", "b"), ("x", "yy?"), ("same", "size"), ("q?", "longer text")]
    concepts = [*CONCEPTS, "lists things with commas"]
    t = texts(spark, pairs)
    single = as_dict(annotate.annotate_matrix(t, concepts, lexical_completer))
    path = str(tmp_path / "multi")
    assert as_dict(annotate.annotate_multi(t, concepts, lexical_completer, cache_path=path)) == single
    assert as_dict(annotate.annotate_multi(t, concepts, failing_completer, cache_path=path)) == single
    # One new concept: every text is asked again; unreadable answers keep what is cached.
    more = as_dict(annotate.annotate_multi(t, [*concepts, "contains digits"], lambda ps: ["?"] * len(ps), cache_path=path))
    assert {k: v for k, v in more.items() if k in single} == single
    assert sorted(v for k, v in more.items() if k not in single) == [0, 0, 0, 0]


def test_embeddings_are_cached_per_model(spark, tmp_path):
    path = str(tmp_path / "emb")
    t = spark.createDataFrame([("one two",), ("three",), (" ",), (None,)], "text string").withColumn("text_key", text_key(F.col("text")))
    got = embed.embed_texts(t, HashingEmbedder(8), "m", path)
    assert got.count() == 2 and abs(sum(v * v for v in got.first().embedding) - 1) < 1e-6
    assert embed.embed_texts(t, failing_completer, "m", path).count() == 2
    assert embed.embed_texts(t, HashingEmbedder(4), "other", path).count() == 2
    assert sorted(len(r.embedding) for r in spark.read.parquet(path).collect()) == [4, 4, 8, 8]


def test_completion_checkpoint_asks_each_prompt_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def counting(ps):
        for p in ps:
            with open(log / p, "a") as f:
                f.write("x")
        return ["a"] * len(ps)

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k int, prompt string")
    done = complete(df, ["k"], counting, lambda a: a, concurrency=2)
    assert done.count() == 20 and done.count() == 20
    assert {f.read_text() for f in log.iterdir()} == {"x"}


def test_abbreviations(spark):
    df = spark.createDataFrame([(0, "is the best"), (1, " "), (2, None), (3, "same")], "neuron_idx int, interpretation string")
    got = {r.neuron_idx: r.abbreviated_interpretation for r in interpret.abbreviate(df, lexical_completer).collect()}
    assert got == {0: "best", 1: "", 2: "", 3: "same"}
    silent = interpret.abbreviate(df, lambda ps: [" "] * len(ps))
    assert {r.neuron_idx: r.abbreviated_interpretation for r in silent.collect()}[0] == "is the best"


def test_prompt_names():
    assert prompts.template("annotate-pairwise") == prompts.template("pairwise-annotate-singleconcept")
    with pytest.raises(KeyError):
        prompts.template("unknown")


ROWS = [("p1", 'a "quoted"\nline', "b", 1.0), ("p2", "c d e", None, 0.0)]


def test_readers_agree(spark, tmp_path):
    with open(tmp_path / "x.jsonl", "w") as f:
        for p, a, b, y in ROWS:
            f.write(json.dumps({"q": p, "response_A": a, "response_B": b, "label": y, "topic": "t"}) + "\n")
    names = loader.ColumnNames(prompt="q")
    from_json = loader.load_preferences(spark, str(tmp_path / "x.jsonl"), columns=names, extra=("topic",))
    plain = spark.createDataFrame([(*r, "t") for r in ROWS], "q string, response_A string, response_B string, label double, topic string")
    plain.coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    plain.coalesce(1).write.csv(str(tmp_path / "x.csv"), header=True, escape='"')
    want = None
    for df in (
        from_json,
        loader.load_preferences(spark, str(tmp_path / "x.parquet"), columns=names, extra=("topic",)),
        loader.load_preferences(spark, str(tmp_path / "x.csv"), columns=names, extra=("topic",), multi_line=True),
    ):
        got = sorted(map(tuple, df.select("prompt", "response_A", "response_B", "label", "length_delta", "topic").collect()))
        want = want or got
        assert got == want == [("p1", 'a "quoted"\nline', "b", 1.0, 2, "t"), ("p2", "c d e", None, 0.0, None, "t")]
        assert df.select("row_id").distinct().count() == 2
    with pytest.raises(ValueError):
        loader.load_preferences(spark, "x.xlsx")
    with pytest.raises(ValueError):
        loader.load_preferences(spark, str(tmp_path / "x.parquet"))
    assert caches.table_exists(spark, str(tmp_path / "x.parquet")) and not caches.table_exists(spark, str(tmp_path / "none"))


def _lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_json_labels_and_lengths(spark, tmp_path):
    base = {"prompt": "p", "response_A": "a b c", "response_B": "b"}
    rows = [
        base | {"label": True}, base | {"label": False, "length_delta": 2.0}, base | {"label": 1},
        base | {"label": 0.5, "length_delta": -7}, base | {"label": None},
    ]
    got = loader.load_preferences(spark, _lines(tmp_path / "x.json", rows)).orderBy("row_id").collect()
    assert [r.label for r in got] == [1.0, 0.0, 1.0, 0.5, None]
    assert [r.length_delta for r in got] == [2, 2, 2, -7, 2]


@pytest.mark.parametrize(
    "row, message",
    [
        ('{"prompt": "p", "response_A": ', "malformed"),
        ({"prompt": "p", "response_A": "a", "response_B": "b", "label": "maybe"}, "no number"),
        ({"prompt": "p", "response_A": "a", "response_B": "b", "label": 1, "length_delta": "x"}, "no number"),
    ],
)
def test_json_rows_that_cannot_be_read(spark, tmp_path, row, message):
    good = {"prompt": "p", "response_A": "a", "response_B": "b", "label": 1}
    with pytest.raises(ValueError, match=message):
        loader.load_preferences(spark, _lines(tmp_path / "x.jsonl", [good, row, good]))


def test_json_without_a_required_column(spark, tmp_path):
    with pytest.raises(ValueError, match="response_B"):
        loader.load_preferences(spark, _lines(tmp_path / "x.jsonl", [{"prompt": "p", "response_A": "a", "label": 1}] * 2))


def test_csv_files_are_split_among_tasks(spark, tmp_path):
    lines = ["label,response_B,prompt,response_A", *[f'{i % 2},b,"p, {i}",a b' for i in range(4000)]]
    path = _lines(tmp_path / "x.csv", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = loader.load_preferences(spark, path)
        assert len(table.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.prompt for r in table.collect()) == sorted(f"p, {i}" for i in range(4000))
    assert table.select("row_id").distinct().count() == 4000
    with pytest.raises(ValueError, match="malformed"):
        loader.load_preferences(spark, _lines(tmp_path / "y.csv", [*lines, "1,b,p,a,too,many"]))


def test_row_ids_do_not_depend_on_how_a_scan_is_cut(spark, tmp_path):
    path = str(tmp_path / "many rows 100%.parquet")
    rows = [(f"p{i}", f"a{i}", "b", 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "prompt string, response_A string, response_B string, label double")
    df.repartition(6).write.option("parquet.block.size", 4096).parquet(path)
    first = {r.row_id: r.prompt for r in loader.load_preferences(spark, path).collect()}
    assert len(first) == 3000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        again = {r.row_id: r.prompt for r in loader.load_preferences(spark, path).select("row_id", "prompt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == first


def test_given_length_delta_is_kept(spark):
    df = spark.createDataFrame([("a b", "c", 9), ("a b", "c", None)], "response_A string, response_B string, length_delta long")
    assert [r.length_delta for r in loader.with_length_delta(df).collect()] == [9, 1]


def small_config(name="small", **runtime):
    return {
        "dataset": {"name": name, "path": "unused", "split_columns": ["prompt", "conversation_id"]},
        "sae": {"M": 6, "K": 2, "prefix_lengths": [3, 6], "batch_size": 32, "n_epochs": 3, "min_epochs": 1},
        "interpretation": {
            "n_candidates": 2, "scoring_n_examples": 30, "p_value_threshold": None,
            "interpret_sampling_kwargs": {"percentile_bin": [50, 100], "swap_negative_response_pairs": True},
        },
        "selection": {"lasso_top_k": [2]},
        "runtime": {"wandb": {"enable": False}, **runtime},
    }


def test_config_rejects_unknown_keys(tmp_path):
    cfg = config.job_config(small_config())
    assert cfg.sae.M == 6 and cfg.interpretation.interpret_config().percentile_bin == (50, 100)
    with pytest.raises(ValueError):
        config.job_config({**small_config(), "other": {}})
    with pytest.raises(ValueError):
        config.job_config({"dataset": {"name": "n", "path": "p", "split_columns": [], "typo": 1}})
    (tmp_path / "list.json").write_text(json.dumps([small_config()["dataset"]]))
    assert config.load_dataset_configs(str(tmp_path / "list.json"))[0].name == "small"
    assert config.for_debug(config.job_config({**small_config(), "sae": {"batch_size": 500}})).sae.batch_size == 128


def test_whole_job_writes_consistent_tables(spark, tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    data = str(tmp_path / "prefs.parquet")
    derived.preferences(spark, SF).drop("row_id", "a_id", "b_id").write.parquet(data)
    spec = small_config(cache_dir=str(tmp_path / "cache"), checkpoint_dir=str(tmp_path / "models"))
    spec["dataset"]["path"] = data
    (folder / "one.json").write_text(json.dumps(spec))
    out = str(tmp_path / "out")
    metrics = sweep.run_sweep(spark, str(folder), out, HashingEmbedder(16), lexical_completer)
    values = {r.metric: r.value for r in metrics.collect()}
    assert values["quality/num_neurons_total"] == 6.0
    assert 0 <= values["full_sae_train_auc"] <= 1 and values["sae/reconstruction_norm_mse_train_val"] > 0
    table = spark.read.json(out + "/one_feature_table").collect()
    assert sorted(r.neuron_idx for r in table) == list(range(6))
    assert all(r.interpretation in lexical_traits() for r in table if r.interpretation)
    assert sum(r.kept for r in table) == values["quality/num_neurons_kept"]
    # The stored encoder and every cached answer are reused: nothing may be asked again.
    cfg = config.job_config(spec)
    data_again = preprocess.load_and_preprocess(spark, cfg.dataset)
    emb = preprocess.embed_responses(data_again, failing_completer, cfg.embedding.model, str(tmp_path / "cache/embeddings"))
    params = features.train_encoder(spark, emb.of("dedup_train"), emb.of("dedup_val"), cfg.sae, cfg.runtime)
    assert params.n_neurons == 6
    # Train and validation share no prompt.
    shared = data_again.wide("train").select("prompt").intersect(data_again.wide("val").select("prompt"))
    assert shared.count() == 0
    sinks.write_interpretations(
        spark.createDataFrame([(0, "a"), (1, "b")], "neuron_idx int, interpretation string"), str(tmp_path / "interp"),
        spark.createDataFrame([(1, 0.5)], "neuron_idx int, selection_score double"), "lasso",
    )
    stored = {r.neuron_idx: r for r in spark.read.parquet(str(tmp_path / "interp")).collect()}
    assert not stored[0].selected and stored[1].selection_score == 0.5 and stored[1].selection_method == "lasso"


def test_roles_and_hooks(spark):
    """Each role asks its own service; samplers and texts may be replaced."""
    seen = []

    def top_zero(acts, cfg):
        seen.append("scoring")
        return sampling.sample_top_zero(acts, cfg.scoring_n_examples)

    def shouted(rows, samples, dataset):
        texts = preprocess.sampled_pair_texts(rows, samples, dataset)
        return texts.withColumn("text", F.upper("text"))

    spec = small_config()
    spec["sae"]["n_epochs"] = 1
    spec["interpretation"]["n_candidates"] = 1
    result = features.run_job(
        spark, config.job_config(spec), HashingEmbedder(16),
        Completers(lexical_completer, lexical_completer, lambda ps: ["short form"] * len(ps)),
        derived.preferences(spark, SF), hooks=features.Hooks(scoring_sampler=top_zero, texts=shouted),
    )
    rows = result.features.collect()
    assert seen == ["scoring"]
    assert {r.abbreviated_interpretation for r in rows} <= {"short form", ""}
    values = {r.metric: r.value for r in result.summary.collect()}
    assert values["data/num_pairs_without_vector"] == 0.0


def lexical_traits():
    from pairlens.operators.completion import LEXICAL_TRAITS

    return set(LEXICAL_TRAITS)


def test_reward_baselines(spark):
    prefs = derived.preferences(spark, "/root/testdata/sf0.01")
    cfg = config.DatasetConfig("set", "unused", ["prompt", "conversation_id"])
    scores = prefs.select("row_id", F.col("label").alias("score_A"), F.lit(0.5).alias("score_B"))
    row = reward.reward_baselines(prefs, cfg, HashingEmbedder(16), reward_scores=scores).first()
    assert row.dataset_name == "set" and row.auc_reward_model == 1.0 and row.acc_reward_model == 1.0
    assert math.isnan(row.auc_sae_full) and 0 <= row.auc_embed_response_only <= 1
    with pytest.raises(ValueError):
        reward.reward_baselines(prefs.filter("label = 0.5"), cfg, HashingEmbedder(16))


def test_reward_baselines_use_a_stored_encoder(spark, tmp_path):
    data, model = str(tmp_path / "p.parquet"), str(tmp_path / "m.parquet")
    derived.preferences(spark, "/root/testdata/sf0.01").drop("row_id").write.parquet(data)
    encoder.save_params(spark, derived.one_hot_params(16, 8, 0.05), model)
    configs = [
        config.DatasetConfig("with", data, ["prompt", "conversation_id"], sae_checkpoint_path=model),
        config.DatasetConfig("without", data, ["prompt"], sae_checkpoint_path=str(tmp_path / "none")),
    ]
    rows = {r.dataset_name: r for r in reward.run_reward_baselines(spark, configs, HashingEmbedder(16)).collect()}
    assert 0 <= rows["with"].auc_sae_full <= 1 and 0 <= rows["with"].auc_sae_top5 <= 1
    assert math.isnan(rows["with"].auc_sae_top10) and math.isnan(rows["without"].auc_sae_full)
