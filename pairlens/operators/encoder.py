"""The sparse autoencoder: parameters, checkpoint table, encoding and reconstruction error."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.vectors import list_column, matrix_of
from pairlens.operators.ordered import equal_slices


@dataclass
class EncoderParams:
    """Weights of a fitted encoder; a few hundred kilobytes, shipped with every task."""

    enc: np.ndarray  # neurons x dims
    dec: np.ndarray  # dims x neurons
    input_bias: np.ndarray
    neuron_bias: np.ndarray
    threshold: float = 0.0
    k: int = 4
    prefix_lengths: list[int] | None = field(default=None)

    @property
    def n_neurons(self) -> int:
        return self.enc.shape[0]

    def activations(self, x: np.ndarray) -> np.ndarray:
        pre = (x - self.input_bias) @ self.enc.T + self.neuron_bias
        return np.where(np.abs(pre) > self.threshold, pre, pre.dtype.type(0))

    def in_float32(self) -> EncoderParams:
        arrays = [a.astype(np.float32) for a in (self.enc, self.dec, self.input_bias, self.neuron_bias)]
        return EncoderParams(*arrays, np.float32(self.threshold), self.k, self.prefix_lengths)


def encode(
    deltas: DataFrame, params: EncoderParams, id: str = "row_id", vector: str = "delta", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, keep..., acts): activations of every row in 32-bit arithmetic, a matrix product per batch."""
    weights = params.in_float32()
    names = [id, *keep]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                acts = weights.activations(matrix_of(batch.column(len(names)), np.float32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], list_column(acts, pa.float32())], names=[*names, "acts"]
                )

    fields = [deltas.schema[name] for name in names]
    schema = T.StructType([*fields, T.StructField("acts", T.ArrayType(T.FloatType()))])
    return deltas.select(*names, vector).mapInArrow(run, schema)


def reconstruction_loss(
    deltas: DataFrame, params: EncoderParams, n_slices: int = 32, id: str = "row_id", vector: str = "delta"
) -> DataFrame:
    """Normalised reconstruction error, averaged over prefixes and near-equal slices.

    Tasks send up squared errors and per-dimension moments per slice, never rows.
    """
    sliced = equal_slices(deltas.select(id, vector), n_slices, id)
    ends = params.prefix_lengths if params.prefix_lengths and len(params.prefix_lengths) > 1 else [params.n_neurons]
    n_ends = len(ends)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            x = matrix_of(batch.column(1))
            acts = params.activations(x)
            errors = np.stack(
                [((acts[:, :e] @ params.dec[:, :e].T + params.input_bias - x) ** 2).sum(axis=1) for e in ends], axis=1
            )
            for s in np.unique(numbers):
                here = numbers == s
                part = np.concatenate(
                    [errors[here].sum(axis=0), [here.sum()], x[here].sum(axis=0), (x[here] ** 2).sum(axis=0)]
                )
                sums[int(s)] = part if int(s) not in sums else sums[int(s)] + part
        for s, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), s, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)],
                names=["slice", "pos", "value"],
            )

    long = sliced.select("slice", vector).mapInArrow(run, "slice int, pos int, value double")
    cells = long.groupBy("slice", "pos").agg(F.sum("value").alias("value"))
    d = params.enc.shape[1]
    # Per slice: the errors by prefix, the row count, then d sums and d sums of squares.
    role = (
        F.when(F.col("pos") < n_ends, F.lit("error")).when(F.col("pos") == n_ends, "rows").otherwise("moment")
    )
    rows = F.max(F.when(F.col("role") == "rows", F.col("value")))
    dim = F.pmod(F.col("pos") - n_ends - 1, F.lit(d))
    moments = (
        cells.withColumns({"role": role, "dim": dim})
        .groupBy("slice", F.when(F.col("role") == "moment", F.col("dim")).alias("dim"))
        .agg(
            rows.alias("n"),
            F.sum(F.when(F.col("role") == "error", F.col("value"))).alias("err"),
            F.sum(F.when((F.col("role") == "moment") & (F.col("pos") <= n_ends + d), F.col("value"))).alias("s1"),
            F.sum(F.when((F.col("role") == "moment") & (F.col("pos") > n_ends + d), F.col("value"))).alias("s2"),
        )
    )
    slices = moments.groupBy("slice").agg(
        F.max("n").alias("n"), F.max("err").alias("err"), F.sum("s2").alias("s2"), F.sum(F.col("s1") ** 2).alias("s1sq")
    )
    base = F.col("s2") - F.col("s1sq") / F.col("n")
    return slices.select(
        "slice", F.try_divide(F.col("err") / n_ends, base).alias("loss")
    ).agg(F.avg("loss").alias("reconstruction_loss"))


def checkpoint_name(n_neurons: int, k: int, prefix_lengths: list[int] | None) -> str:
    # Name stems of stored models.
    if prefix_lengths is None:
        return f"SAE_M={n_neurons}_K={k}.parquet"
    prefixes = "-".join(str(p) for p in prefix_lengths)
    return f"SAE_matryoshka_M={n_neurons}_K={k}_prefixes={prefixes}.parquet"


PARAMS_SCHEMA = (
    "enc array<array<double>>, dec array<array<double>>, input_bias array<double>, "
    "neuron_bias array<double>, threshold double, k int, prefix_lengths array<int>"
)


def save_params(spark: SparkSession, params: EncoderParams, path: str) -> None:
    row = (
        params.enc.astype(float).tolist(),
        params.dec.astype(float).tolist(),
        params.input_bias.astype(float).tolist(),
        params.neuron_bias.astype(float).tolist(),
        float(params.threshold),
        int(params.k),
        params.prefix_lengths,
    )
    spark.createDataFrame([row], PARAMS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> EncoderParams:
    r = spark.read.schema(PARAMS_SCHEMA).parquet(path).first()
    return EncoderParams(
        np.array(r.enc), np.array(r.dec), np.array(r.input_bias), np.array(r.neuron_bias),
        r.threshold, r.k, list(r.prefix_lengths) if r.prefix_lengths is not None else None,
    )


def params_exist(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
