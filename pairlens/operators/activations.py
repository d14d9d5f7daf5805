"""Feature activations: wide rows, long rows, firing statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_activations(acts: DataFrame, id: str = "row_id", nonzero: bool = True) -> DataFrame:
    """(id, neuron_idx, act); zeros are left out unless asked for."""
    long = acts.select(id, F.posexplode("acts").alias("neuron_idx", "act"))
    return long.filter("act <> 0") if nonzero else long


def firing_rates(acts: DataFrame) -> DataFrame:
    """Per neuron: share of rows with a non-zero activation, signed sum and never-fired flag.

    ``dead`` follows the signed column sum, which may cancel; ``never_fired`` is exact. Null
    activations are left out, and so are rows without any. Tasks add
    up their rows, so one row per neuron and task is shuffled.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, 0))
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(float)
            sizes = np.diff(offsets)
            at = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            known = ~np.isnan(values)
            n = max(int(sizes.max(initial=0)), totals.shape[1])
            grown = np.zeros((3, n))
            grown[:, : totals.shape[1]] = totals
            grown[0] += np.bincount(at[known], minlength=n)
            grown[1] += np.bincount(at[known], values[known] != 0, n)
            grown[2] += np.bincount(at[known], values[known], n)
            totals = grown
        if totals.shape[1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(totals.shape[1], dtype=np.int32)), *[pa.array(t) for t in totals]],
                names=["neuron_idx", "rows", "fired", "total"],
            )

    sums = acts.filter(F.col("acts").isNotNull()).select("acts").mapInArrow(
        add, "neuron_idx int, rows double, fired double, total double"
    )
    return sums.groupBy("neuron_idx").agg(
        (F.sum("fired") / F.sum("rows")).alias("prevalence"),
        (F.sum("total") == 0).alias("dead"),
        (F.sum("fired") == 0).alias("never_fired"),
    )


def activity_summary(acts: DataFrame) -> DataFrame:
    """One row: dead neurons, never-fired neurons, mean number of active neurons per row."""
    neurons = firing_rates(acts)
    return neurons.agg(
        F.count_if("dead").alias("n_dead"),
        F.count_if("never_fired").alias("n_never_fired"),
        F.sum("prevalence").alias("mean_active_per_row"),
    )
