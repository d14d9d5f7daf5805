"""Encoder, selection and probes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators import activations, encoder, encoder_fit, linear, probe, redundancy
from pairlens.operators.dedup import augment_signs
from pairlens.operators.encoder import EncoderParams
from pairlens.operators.encoder_fit import FitConfig, initial_state, loss_and_gradients


def vectors(spark, x, name="delta", parts=3):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"row_id long, {name} array<float>").repartition(parts)


@pytest.mark.parametrize("training", [True, False])
@pytest.mark.parametrize("multi", [False, True])
def test_gradients_match_finite_differences(training, multi):
    rng = np.random.default_rng(4)
    cfg = FitConfig(n_neurons=6, k=2, prefix_lengths=[2, 6], dead_after_steps=3, aux_k=2,
                    multi_k=3 if multi else None, multi_coef=0.3 if multi else 0.0)
    x = rng.normal(size=(9, 5))
    base = initial_state(rng.normal(size=5) * 0.1, cfg)
    base.threshold = 0.4
    base.idle = np.array([0.0, 9, 0, 9, 0, 0])
    base.weights["neuron_bias"] = rng.normal(size=6) * 0.05
    base.weights["neuron_bias"][[1, 3]] = -0.01
    # The auxiliary term holds the residual constant, which differences would not; it is
    # switched off here and checked below.
    plain = FitConfig(**{**vars(cfg), "aux_coef": 0.0})
    _, grads = loss_and_gradients(base.refill(base.flat()), x, plain, training)
    for name in grads:
        for index in np.ndindex(grads[name].shape):
            values = []
            for shift in (1e-6, -1e-6):
                state = base.refill(base.flat())
                state.weights[name][index] += shift
                values.append(loss_and_gradients(state, x, plain, training)[0])
            numeric = (values[0] - values[1]) / 2e-6
            assert numeric == pytest.approx(grads[name][index], abs=2e-6), (name, index)


def test_auxiliary_gradient_with_the_residual_held_constant():
    rng = np.random.default_rng(5)
    cfg = FitConfig(n_neurons=5, k=1, prefix_lengths=None, dead_after_steps=2, aux_k=2, aux_coef=0.5)
    plain = FitConfig(**{**vars(cfg), "aux_coef": 0.0})
    x = rng.normal(size=(7, 4))
    base = initial_state(np.zeros(4), cfg)
    base.threshold, base.idle = 50.0, np.array([9.0, 9, 0, 9, 0])  # nothing fires: residual = x - bias
    with_aux = loss_and_gradients(base.refill(base.flat()), x, cfg, False)[1]
    without = loss_and_gradients(base.refill(base.flat()), x, plain, False)[1]

    def aux_loss(state):
        pre = x @ state.weights["enc"].T + state.weights["neuron_bias"]
        offered = pre * np.array([1, 1, 0, 1, 0])
        code = np.zeros_like(offered)
        for r in range(len(x)):
            for j in np.argsort(-offered[r])[:2]:
                code[r, j] = offered[r, j]
        return 0.5 * ((code @ state.weights["dec"].T - x) ** 2).mean() / ((x - x.mean(0)) ** 2).mean()

    for name in ("enc", "dec", "neuron_bias"):
        for index in np.ndindex(with_aux[name].shape):
            values = []
            for shift in (1e-6, -1e-6):
                state = base.refill(base.flat())
                state.weights[name][index] += shift
                values.append(aux_loss(state))
            numeric = (values[0] - values[1]) / 2e-6
            assert numeric == pytest.approx(with_aux[name][index] - without[name][index], abs=1e-6), name


def planted(n=3000, d=12, m=4, seed=0):
    """Rows that are one of m orthogonal directions, either way round, plus a little noise."""
    rng = np.random.default_rng(seed)
    atoms = np.linalg.qr(rng.normal(size=(d, m)))[0].T
    codes = np.zeros((n, m))
    codes[np.arange(n), rng.integers(0, m, n)] = rng.choice([-1.0, 1.0], n) * rng.uniform(0.5, 1.5, n)
    return (codes @ atoms + 0.01 * rng.normal(size=(n, d))).astype(np.float32), atoms


@pytest.mark.parametrize("parts", [1, 4])
def test_fit_recovers_planted_directions(spark, parts):
    x, atoms = planted()
    train = augment_signs(vectors(spark, x[:2500]))
    cfg = FitConfig(n_neurons=8, k=1, prefix_lengths=None, batch_size=64, n_epochs=25, min_epochs=5, learning_rate=1e-2)
    params, history = encoder_fit.fit_encoder(train, vectors(spark, x[2500:]), cfg, n_partitions=parts)
    assert history[-1]["val_loss"] < 0.5 * history[0]["val_loss"]
    assert (np.abs(params.dec.T @ atoms.T).max(axis=0) > 0.9).all()
    np.testing.assert_allclose(np.linalg.norm(params.dec, axis=0), 1.0, atol=1e-6)


@pytest.mark.parametrize("rows_per_shard", [1_000_000, 150])
def test_fit_does_not_depend_on_tasks(spark, rows_per_shard):
    x, _ = planted(n=513)
    cfg = FitConfig(
        n_neurons=8, k=2, prefix_lengths=[4, 8], batch_size=64, n_epochs=6, min_epochs=2, rows_per_shard=rows_per_shard
    )
    fits, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffle in ((1, 2), (4, 8), (16, 2), (None, 8)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            train = vectors(spark, x[:449]).repartition(parts or 3)
            fits.append(encoder_fit.fit_encoder(train, vectors(spark, x[449:]).repartition(5), cfg, n_partitions=parts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for params, history in fits[1:]:
        np.testing.assert_allclose(params.enc, fits[0][0].enc, atol=1e-6)
        np.testing.assert_allclose(params.dec, fits[0][0].dec, atol=1e-6)
        assert params.threshold == pytest.approx(fits[0][0].threshold, abs=1e-6)
        assert [h["val_loss"] for h in history] == pytest.approx([h["val_loss"] for h in fits[0][1]], abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 64, 65, 128, 129, 16 * 64, 16 * 64 + 1, 2500])
def test_mini_batches_hold_every_row(n):
    x = np.arange(n, dtype=float)[:, None]
    for cut in (1, 7, 1000):
        parts = [x[i : i + cut] for i in range(0, n, cut)]
        plain = list(encoder_fit._mini_batches(iter(parts), 64, None))
        assert np.concatenate(plain).ravel().tolist() == list(range(n))
        assert n < 2 or min(map(len, plain)) >= 2
        mixed = list(encoder_fit._mini_batches(iter(parts), 64, np.random.default_rng(0)))
        assert [len(b) for b in mixed] == [len(b) for b in plain]
        assert sorted(np.concatenate(mixed).ravel().tolist()) == list(range(n))


def test_invalid_prefixes_are_rejected():
    with pytest.raises(ValueError):
        FitConfig(n_neurons=8, prefix_lengths=[4, 6])
    with pytest.raises(ValueError):
        FitConfig(n_neurons=8, prefix_lengths=[8, 8])


def test_encoding_storage_and_losses(spark, tmp_path):
    rng = np.random.default_rng(1)
    params = EncoderParams(rng.normal(size=(6, 5)), rng.normal(size=(5, 6)), rng.normal(size=5), rng.normal(size=6), 0.7, 2, [3, 6])
    x = rng.normal(size=(70, 5)).astype(np.float32)
    df = vectors(spark, x)
    got = {r.row_id: r.acts for r in encoder.encode(df, params).collect()}
    pre = (x - params.input_bias) @ params.enc.T + params.neuron_bias
    want = np.where(np.abs(pre) > 0.7, pre, 0)
    np.testing.assert_allclose([got[i] for i in range(70)], want, atol=1e-4)

    path = str(tmp_path / encoder.checkpoint_name(6, 2, [3, 6]))
    assert path.endswith("SAE_matryoshka_M=6_K=2_prefixes=3-6.parquet") and not encoder.params_exist(spark, path)
    encoder.save_params(spark, params, path)
    assert encoder.params_exist(spark, path)
    again = encoder.load_params(spark, path)
    np.testing.assert_array_equal(again.enc, params.enc)
    assert again.prefix_lengths == [3, 6] and again.threshold == 0.7

    losses = []
    for part in np.array_split(np.arange(70), 8):
        xs, acts = x[part].astype(float), params.activations(x[part].astype(float))
        base = ((xs - xs.mean(0)) ** 2).mean()
        losses.append(np.mean([((acts[:, :e] @ params.dec[:, :e].T + params.input_bias - xs) ** 2).mean() / base for e in (3, 6)]))
    loss = encoder.reconstruction_loss(df, params, 8).first()[0]
    assert loss == pytest.approx(np.mean(losses), rel=1e-9)

    rates = {r.neuron_idx: r for r in activations.firing_rates(encoder.encode(df, params)).collect()}
    np.testing.assert_allclose([rates[i].prevalence for i in range(6)], (want != 0).mean(0))


def labelled(spark, n=600, m=6, seed=3, binary=True):
    rng = np.random.default_rng(seed)
    acts = rng.normal(size=(n, m)) * (rng.random((n, m)) < 0.6)
    acts[:, m - 1] = 0.0  # a neuron that never fires
    length = rng.normal(size=n) * 20 + 5
    signal = 1.2 * acts[:, 0] - 0.8 * acts[:, 2] + 0.03 * length
    y = (rng.random(n) < 1 / (1 + np.exp(-signal))).astype(float) if binary else signal + rng.normal(size=n)
    rows = [(i, [float(v) for v in a], float(c), float(t)) for i, (a, c, t) in enumerate(zip(acts, length, y))]
    df = spark.createDataFrame(rows, "row_id long, acts array<double>, length_delta double, label double")
    return df.repartition(5), acts, length, y


def scaled(x):
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1)


def newton(z, y, ridge=0.0, skip=()):
    z = np.column_stack([z, np.ones(len(z))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 0
    b = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-12 * np.eye(len(b)), z.T @ (p - y) + penalty * b)
    return b


def test_controlled_coefficients(spark):
    df, acts, length, y = labelled(spark)
    got = {r.neuron_idx: r.coef for r in linear.controlled_coefs(df, ["length_delta"]).collect()}
    for j in range(5):
        want = newton(scaled(np.column_stack([length, acts[:, j]])), y)[1]
        assert got[j] == pytest.approx(want, abs=1e-8)
    assert got[5] is None  # singular for this neuron only

    df, acts, length, y = labelled(spark, binary=False)
    got = {r.neuron_idx: r.coef for r in linear.controlled_coefs(df, ["length_delta"], classification=False).collect()}
    for j in range(5):
        z = np.column_stack([scaled(np.column_stack([length, acts[:, j]])), np.ones(len(y))])
        assert got[j] == pytest.approx(np.linalg.lstsq(z, y, rcond=None)[0][1], abs=1e-8)


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("k", [1, 2, 4])
def test_controlled_lasso_meets_the_optimality_conditions(spark, binary, k):
    df, acts, length, y = labelled(spark, binary=binary)
    out = linear.controlled_lasso(df, k, ["length_delta"], classification=binary)
    assert len(out.neurons) == k and list(np.abs(out.coefs)) == sorted(np.abs(out.coefs), reverse=True)
    assert out.neurons[0] == 0
    z = scaled(np.column_stack([length, acts]))
    beta = np.zeros(7)
    beta[[1 + i for i in out.neurons]] = out.coefs
    # Control and intercept are free: solve them given the features, then check the gradient.
    offset = z[:, 1:] @ beta[1:]
    free = np.column_stack([z[:, 0], np.ones(len(y))])
    b = np.zeros(2)
    for _ in range(100):
        f = free @ b + offset
        mean = 1 / (1 + np.exp(-f)) if binary else f
        w = mean * (1 - mean) if binary else np.ones_like(f)
        b -= np.linalg.solve((free * w[:, None]).T @ free, free.T @ (mean - y))
    f = free @ b + offset
    grad = z[:, 1:].T @ ((1 / (1 + np.exp(-f)) if binary else f) - y) / len(y)
    for j in range(6):
        if j in out.neurons:
            assert grad[j] == pytest.approx(-out.alpha * np.sign(beta[1 + j]), abs=1e-5)
        else:
            assert abs(grad[j]) <= out.alpha + 1e-6


def test_lasso_edges(spark):
    df, *_ = labelled(spark, n=200)
    with pytest.raises(ValueError):
        linear.controlled_lasso(df, 6, ["length_delta"])  # only five neurons ever fire
    sampled = linear.controlled_lasso(df, 2, [], max_samples=150)
    assert len(sampled.neurons) == 2
    plain = linear.lasso_select(df, 3, classification=True)
    assert len(plain.neurons) == 3 and plain.neurons[0] == 0
    strict = linear.lasso_select(df, 3, alpha=1e3)
    assert strict.coefs == [0.0, 0.0, 0.0]
    assert plain.table(spark).columns == ["neuron_idx", "coef"]


@pytest.mark.parametrize("standardize", [True, False])
def test_probe_equals_penalised_newton(spark, standardize):
    df, acts, length, y = labelled(spark, n=400)
    rows = df.select("row_id", "label", probe.feature_vector(F.col("acts"), F.array("length_delta")).alias("features"))
    model = probe.fit_probe(rows, c=0.5, standardize=standardize)
    x = np.column_stack([acts, length])
    z = scaled(x) if standardize else x
    b = newton(z, y, ridge=2.0)
    want = 1 / (1 + np.exp(-(z @ b[:-1] + b[-1])))
    got = {r.row_id: r.score for r in probe.probe_scores(model, rows).collect()}
    np.testing.assert_allclose([got[i] for i in range(400)], want, atol=2e-4)
    report = {r.split: r for r in probe.linear_probe(rows, rows).collect()}
    assert report["train"].score == report["val"].score > 0.6


@pytest.mark.parametrize("standardize", [True, False])
def test_numeric_label_uses_ridge(spark, standardize):
    df, acts, length, y = labelled(spark, n=300, binary=False)
    rows = df.select("row_id", "label", probe.feature_vector(F.col("acts"), F.array("length_delta")).alias("features"))
    x = np.column_stack([acts, length])
    z = scaled(x) if standardize else x - x.mean(0)
    w = np.linalg.solve(z.T @ z + 1.5 * np.eye(7), z.T @ (y - y.mean()))
    model = probe.fit_probe(rows, c=1.5, binary=False, standardize=standardize)
    got = {r.row_id: r.score for r in probe.probe_scores(model, rows).collect()}
    np.testing.assert_allclose([got[i] for i in range(300)], z @ w + y.mean(), atol=1e-6)
    assert not probe.labels_are_binary(rows)
    report = probe.linear_probe(rows, rows, c=1.5, standardize=standardize).first()
    assert report.score == pytest.approx(np.corrcoef(y, z @ w)[0, 1], abs=1e-6)


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_redundancy_in_blocks_equals_all_pairs(spark, block_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(11, 3))
    x[4] = 0.0
    x[9] = x[2] * 2
    x[10] = x[2]
    rows = [(i, f"t{i}", [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>").repartition(4)
    table, n_components = redundancy.redundancy(df, 0.8, block_rows)
    norms = np.linalg.norm(x, axis=1)
    sims = np.zeros((11, 11))
    for i in range(11):
        for j in range(11):
            if i != j and norms[i] * norms[j] > 0:
                sims[i, j] = x[i] @ x[j] / (norms[i] * norms[j])
    got = {r.id: r for r in table.collect()}
    for i in range(11):
        assert got[i].semantic_redundancy == pytest.approx(sims[i].max(), abs=1e-12)
        assert sims[i, int(got[i].semantic_neighbor[1:])] == pytest.approx(sims[i].max(), abs=1e-12)
    from tests.test_pairs import components_by_hand

    labels = components_by_hand([(i, j) for i in range(11) for j in range(11) if i == j or sims[i, j] > 0.8])
    assert n_components == len(set(labels.values()))


def test_redundancy_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string, embedding array<double>")
    table, components = redundancy.redundancy(none)
    assert table.count() == 0 and components == 0
