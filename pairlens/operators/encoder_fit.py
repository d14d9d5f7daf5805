"""Fitting the sparse autoencoder: local mini-batch steps per shard, averaged once per epoch.

Rows belong to shards by a hash of their id; the number of shards follows from the number of rows
and ``rows_per_shard`` alone. Each epoch is one Spark job. A task streams its shards one after the
other in hash order, steps through their mini-batches with a copy of the parameters of its own and
emits the result as (position, value) rows; an ordinary aggregation averages them by rows seen.
Tasks, partitions and Arrow batches decide where a shard is worked off, never what it computes, so
the model is the same on any cluster. Only model-sized data reaches the driver. Up to
``rows_per_shard`` rows this is plain mini-batch training.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import matrix_of
from pairlens.operators.dedup import seeded_rank
from pairlens.operators.encoder import EncoderParams
from pairlens.operators.ordered import exact_quantiles


@dataclass
class FitConfig:
    n_neurons: int = 32
    k: int = 4
    prefix_lengths: list[int] | None = field(default_factory=lambda: [8, 32])
    batch_size: int = 256
    n_epochs: int = 50
    min_epochs: int = 10
    patience: int = 3
    learning_rate: float = 5e-4
    dead_after_steps: int = 64
    aux_k: int | None = None
    multi_k: int | None = None
    aux_coef: float = 1 / 32
    multi_coef: float = 0.0
    clip_norm: float | None = 1.0
    seed: int = 42
    rows_per_shard: int = 1_000_000  # thousands of steps per epoch and shard

    def __post_init__(self) -> None:
        if self.prefix_lengths is not None:
            if self.prefix_lengths[-1] != self.n_neurons:
                raise ValueError("the last prefix must cover all neurons")
            if any(b <= a for a, b in zip(self.prefix_lengths, self.prefix_lengths[1:])):
                raise ValueError("prefixes must increase")
        if self.aux_k is None:
            self.aux_k = min(2 * self.k, self.n_neurons)

    @property
    def ends(self) -> list[int]:
        return self.prefix_lengths or [self.n_neurons]


@dataclass
class FitState:
    """Parameters, Adam moments and firing counters; moved between tasks as one flat vector."""

    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    steps: float
    threshold: float
    idle: np.ndarray  # steps since each neuron fired

    def flat(self) -> np.ndarray:
        parts = [t[name].ravel() for t in (self.weights, self.first, self.second) for name in WEIGHTS]
        return np.concatenate([*parts, [self.steps, self.threshold], self.idle])

    def refill(self, flat: np.ndarray) -> FitState:
        at = 0
        tables: list[dict[str, np.ndarray]] = []
        for table in (self.weights, self.first, self.second):
            filled = {}
            for name in WEIGHTS:
                size = table[name].size
                filled[name] = flat[at : at + size].reshape(table[name].shape).copy()
                at += size
            tables.append(filled)
        return FitState(*tables, flat[at], flat[at + 1], flat[at + 2 :].copy())


WEIGHTS = ("enc", "dec", "input_bias", "neuron_bias")


def unit_columns(dec: np.ndarray) -> np.ndarray:
    return dec / (np.linalg.norm(dec, axis=0, keepdims=True) + 1e-8)


def initial_state(input_bias: np.ndarray, cfg: FitConfig) -> FitState:
    """Bias at the column medians, uniform decoder with unit columns, encoder its transpose."""
    d = len(input_bias)
    bound = np.sqrt(6.0 / (d + cfg.n_neurons))
    dec = unit_columns(np.random.default_rng(cfg.seed).uniform(-bound, bound, (d, cfg.n_neurons)))
    weights = {
        "enc": dec.T.copy(), "dec": dec, "input_bias": np.asarray(input_bias, float), "neuron_bias": np.zeros(cfg.n_neurons)
    }
    zeros = {n: np.zeros_like(w) for n, w in weights.items()}
    return FitState(weights, zeros, {n: z.copy() for n, z in zeros.items()}, 0.0, 0.0, np.zeros(cfg.n_neurons))


def _strongest(scores: np.ndarray, k: int) -> np.ndarray:
    """0/1 mask of the k largest scores in each row."""
    mask = np.zeros(scores.shape)
    if k > 0:
        top = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
        np.put_along_axis(mask, top, 1.0, axis=1)
    return mask


def loss_and_gradients(
    state: FitState, x: np.ndarray, cfg: FitConfig, training: bool, gradients: bool = True
) -> tuple[float, dict[str, np.ndarray]]:
    """Loss of a batch and its gradients (none without ``gradients``); advances the firing counters
    and the threshold."""
    w = state.weights
    centred = x - w["input_bias"]
    pre = centred @ w["enc"].T + w["neuron_bias"]
    rows, d = x.shape
    if training:
        keep = min(cfg.k * rows, pre.size)
        mask = _strongest(np.abs(pre).reshape(1, -1), keep).reshape(pre.shape)
        kept = np.abs(pre[mask > 0])
        kept = kept[kept > 0]
        if kept.size:
            state.threshold = 0.99 * state.threshold + 0.01 * kept.min()
    else:
        mask = (np.abs(pre) > state.threshold).astype(float)
    acts = pre * mask
    state.idle = np.where(np.abs(acts).sum(axis=0) > 0, 0.0, state.idle + 1)

    base = ((x - x.mean(axis=0)) ** 2).mean()
    d_pre = np.zeros_like(pre)
    grads = {n: np.zeros_like(v) for n, v in w.items()}
    loss = 0.0

    def reconstruct(code: np.ndarray, end: int, weight: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Weighted error of a code over the first ``end`` neurons, its code gradient and differences."""
        diff = code[:, :end] @ w["dec"][:, :end].T + w["input_bias"] - x
        error = weight * (diff**2).mean() / base
        if not gradients:
            return error, d_pre, diff
        grad = diff * (2.0 * weight / (rows * d * base))
        grads["dec"][:, :end] += grad.T @ code[:, :end]
        grads["input_bias"] += grad.sum(axis=0)
        back = np.zeros_like(code)
        back[:, :end] = grad @ w["dec"][:, :end]
        return error, back, diff

    for end in cfg.ends:
        part, back, diff = reconstruct(acts, end, 1.0 / len(cfg.ends))
        loss += part
        if gradients:
            d_pre += back * mask
    # The last prefix covers all neurons.
    residual = -diff
    if cfg.multi_k is not None and cfg.multi_coef != 0:
        wide = _strongest(np.abs(pre), cfg.multi_k)
        part, back, _ = reconstruct(pre * wide, cfg.n_neurons, cfg.multi_coef)
        loss += part
        if gradients:
            d_pre += back * wide

    # Silent neurons learn to explain what the others leave over; the residual is a constant.
    silent = (state.idle > cfg.dead_after_steps).astype(float)
    spread = ((residual - residual.mean(axis=0)) ** 2).mean()
    if silent.any():
        offered = pre * silent
        chosen = _strongest(offered, cfg.aux_k)
        code = offered * chosen
        diff = code @ w["dec"].T - residual
    loss += cfg.aux_coef * (diff**2).mean() / spread
    if not gradients:
        return float(loss), {}
    if silent.any():
        grad = diff * (2.0 * cfg.aux_coef / (rows * d * spread))
        grads["dec"] += grad.T @ code
        d_pre += (grad @ w["dec"]) * chosen * silent

    grads["enc"] = d_pre.T @ centred
    grads["neuron_bias"] = d_pre.sum(axis=0)
    grads["input_bias"] -= (d_pre @ w["enc"]).sum(axis=0)
    return float(loss), grads


def train_step(state: FitState, x: np.ndarray, cfg: FitConfig) -> float:
    loss, grads = loss_and_gradients(state, x, cfg, training=True)
    dec = state.weights["dec"]
    grads["dec"] = grads["dec"] - (dec * grads["dec"]).sum(axis=0, keepdims=True) * dec
    if cfg.clip_norm is not None:
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        scale = min(1.0, cfg.clip_norm / (norm + 1e-6))
        grads = {n: g * scale for n, g in grads.items()}
    state.steps += 1
    for name, g in grads.items():
        # Adam with its usual decay rates.
        state.first[name] = 0.9 * state.first[name] + 0.1 * g
        state.second[name] = 0.999 * state.second[name] + 0.001 * g**2
        m = state.first[name] / (1 - 0.9**state.steps)
        v = state.second[name] / (1 - 0.999**state.steps)
        state.weights[name] = state.weights[name] - cfg.learning_rate * m / (np.sqrt(v) + 1e-8)
    state.weights["dec"] = unit_columns(state.weights["dec"])
    return loss


POOL_BATCHES = 16


def _mini_batches(parts: Iterator[np.ndarray], size: int, rng: np.random.Generator | None) -> Iterator[np.ndarray]:
    """Cut the rows of a shard, in their order, into mini-batches.

    With ``rng``, pools of 16 mini-batches are shuffled first. A single row left at the end joins
    the mini-batch before it.
    """
    before: np.ndarray | None = None
    for pool in _cut(parts, POOL_BATCHES * size):
        if rng is not None:
            pool = pool[rng.permutation(len(pool))]
        for start in range(0, len(pool), size):
            batch = pool[start : start + size]
            if before is not None and len(batch) == 1:
                batch, before = np.concatenate([before, batch]), None
            if before is not None:
                yield before
            before = batch
    if before is not None:
        yield before


def _cut(parts: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    count = 0
    for x in parts:
        held.append(x)
        count += len(x)
        while count >= size:
            merged = np.concatenate(held)
            yield merged[:size]
            held, count = [merged[size:]], count - size
    if count:
        yield np.concatenate(held)


BLOCK_BYTES = 8192  # an Arrow batch holds ten thousand blocks


def _packed(rows: DataFrame, vector: str) -> DataFrame:
    """(shard, width, single, block) of rows (vector, shard) sorted by shard: the bytes of a few vectors of a shard.

    The epochs read them many times; numbers of a list column would be copied one by one each time.
    """
    single = rows.schema[vector].dataType.elementType.typeName() == "float"
    dtype = np.dtype("<f4" if single else "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, shards = matrix_of(batch.column(0), dtype), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            size = max(1, BLOCK_BYTES // (x.shape[1] * dtype.itemsize))
            for first, part in zip(np.r_[0, cuts], np.split(x, cuts)):
                blocks = [part[at : at + size].tobytes() for at in range(0, len(part), size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(blocks), shards[first], np.int32)),
                        pa.array(np.full(len(blocks), x.shape[1], np.int32)),
                        pa.array([single] * len(blocks)),
                        pa.array(blocks, pa.binary()),
                    ],
                    names=["shard", "width", "single", "block"],
                )

    return rows.mapInArrow(pack, "shard int, width int, single boolean, block binary")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(shard, its matrices) for Arrow batches of packed rows that are sorted by shard."""

    def pieces() -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, blocks = batch.column(0).to_numpy(), batch.column(3)
            width, single = batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
            cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)]
            for first, end in zip(cuts, cuts[1:]):
                for at in range(first, end, 256):
                    held = b"".join(blocks.slice(at, min(256, end - at)).to_pylist())
                    yield int(shards[first]), np.frombuffer(held, "<f4" if single else "<f8").reshape(-1, width).astype(float)

    for shard, group in itertools.groupby(pieces(), key=lambda p: p[0]):
        yield shard, (part for _, part in group)


def _positions(values: np.ndarray, weight: float, chunk: int = 65_536):
    for start in range(0, len(values), chunk):
        part = values[start : start + chunk]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(start, start + len(part), dtype=np.int32)),
                pa.array(part),
                pa.array(np.full(len(part), weight)),
            ],
            names=["pos", "value", "weight"],
        )


EPOCH_SCHEMA = "pos int, value double, weight double"


def _run_epoch(data: DataFrame, state: FitState, cfg: FitConfig, epoch: int, training: bool) -> tuple[FitState, float]:
    """One pass: returns the averaged state and the mean mini-batch loss."""
    start = state.flat()

    def run(batches):
        for shard, parts in _by_shard(batches):
            local = state.refill(start)
            rng = np.random.default_rng([cfg.seed, epoch, shard]) if training else None
            losses, rows = [], 0
            for x in _mini_batches(parts, cfg.batch_size, rng):
                if len(x) < 2:
                    continue  # a shard of one row: no spread to normalise by
                rows += len(x)
                if training:
                    losses.append(train_step(local, x, cfg))
                else:
                    losses.append(loss_and_gradients(local, x, cfg, training=False, gradients=False)[0])
            if losses:
                yield from _positions(np.concatenate([local.flat(), [sum(losses), len(losses)]]), float(rows))

    merged = (
        data.mapInArrow(run, EPOCH_SCHEMA)
        .groupBy("pos")
        .agg(
            (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"),
            F.min("value").alias("least"),
            F.sum("value").alias("total"),
        )
        .orderBy("pos")
        .toPandas()
    )
    if merged.empty:
        return state, float("nan")
    flat = merged["mean"].to_numpy().copy()
    idle = slice(len(start) - cfg.n_neurons, len(start))
    flat[idle] = merged["least"].to_numpy()[idle]
    loss = merged["total"].to_numpy()[-2] / merged["total"].to_numpy()[-1]
    averaged = state.refill(flat[: len(start)])
    averaged.weights["dec"] = unit_columns(averaged.weights["dec"])
    return averaged, float(loss)


def lower_medians(deltas: DataFrame, vector: str = "delta", accuracy: int = 1000) -> DataFrame:
    """(dim, median): exact lower median of every vector component."""
    long = deltas.select(F.posexplode(vector).alias("dim", "value"))
    medians = exact_quantiles(long, ["dim"], "value", [0.5], interpolate=False, accuracy=accuracy)
    return medians.select("dim", F.element_at("q", 1).alias("median"))


def _sharded(rows: DataFrame, id: str, vector: str, cfg: FitConfig, n_partitions: int | None) -> DataFrame:
    """Packed rows, each shard whole in one partition and in seeded hash order."""
    parts = [F.col(c) for c in (id, "sign") if c in rows.columns]
    n_shards = max(1, -(-rows.count() // cfg.rows_per_shard))
    placed = rows.select(
        vector,
        F.pmod(F.xxhash64(F.lit(cfg.seed), *parts), F.lit(n_shards)).cast("int").alias("_shard"),
        seeded_rank(cfg.seed, *parts).alias("_order"),
        *[p.alias(f"_tie{i}") for i, p in enumerate(parts)],
    )
    ties = [f"_tie{i}" for i in range(len(parts))]
    spread = placed.repartition(n_partitions or n_shards, "_shard")
    return _packed(spread.sortWithinPartitions("_shard", "_order", *ties).select(vector, "_shard"), vector)


def fit_encoder(
    train: DataFrame,
    val: DataFrame | None,
    cfg: FitConfig,
    n_partitions: int | None = None,
    id: str = "row_id",
    vector: str = "delta",
) -> tuple[EncoderParams, list[dict[str, float]]]:
    """Fit on ``train`` vectors, stop early on ``val``; returns parameters and history.

    ``n_partitions`` says where shards are worked off; the result does not depend on it.
    """
    data = _sharded(train, id, vector, cfg, n_partitions).persist(StorageLevel.MEMORY_AND_DISK)
    held_out = None
    if val is not None:
        held_out = _sharded(val, id, vector, cfg, n_partitions).persist(StorageLevel.MEMORY_AND_DISK)
    # Over the rows as they come: the shards are few, and a sole one would do this in one task.
    medians = lower_medians(train, vector).orderBy("dim").toPandas()["median"].to_numpy(float)
    state = initial_state(medians, cfg)
    best, best_loss, misses = state, float("inf"), 0
    history: list[dict[str, float]] = []
    for epoch in range(cfg.n_epochs):
        state, train_loss = _run_epoch(data, state, cfg, epoch, training=True)
        entry = {
            "epoch": epoch,
            "train_loss": train_loss,
            "val_loss": float("nan"),
            "dead_neuron_ratio": float((state.idle > cfg.dead_after_steps).mean()),
        }
        history.append(entry)
        if held_out is None:
            best = state
            continue
        after, entry["val_loss"] = _run_epoch(held_out, state, cfg, epoch, training=False)
        state = replace(state, idle=after.idle)
        if entry["val_loss"] < best_loss - 1e-6:
            best, best_loss, misses = state, entry["val_loss"], 0
        else:
            misses += 1
            if misses >= cfg.patience and epoch + 1 >= cfg.min_epochs:
                break
    data.unpersist()
    if held_out is not None:
        held_out.unpersist()
    w = best.weights
    params = EncoderParams(
        w["enc"], w["dec"], w["input_bias"], w["neuron_bias"], float(best.threshold), cfg.k, cfg.prefix_lengths
    )
    return params, history
