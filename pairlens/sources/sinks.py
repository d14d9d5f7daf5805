"""Writing results: line-delimited JSON for tables, long tables for metrics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written, so every row has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_job_result(result, out_dir: str, prefix: str = "") -> None:
    """Feature table, summary and predictive metrics, coefficients and descriptions."""
    features = result.features
    tables = {
        "feature_table": features,
        "summary_metrics": result.summary,
        "predictive_metrics": result.selections.aucs,
        "lasso_coefficients": result.selections.coefs,
        "logit_coefficients": features.select(
            "neuron_idx", F.col("length_controlled_logit_coef").alias("coef")
        ),
    }
    for name, df in tables.items():
        write_json_lines(df, os.path.join(out_dir, prefix + name))


def write_interpretations(
    interpretations: DataFrame, path: str, selection: DataFrame | None = None, method: str | None = None
) -> None:
    """Descriptions per neuron, with selection score and method where given.

    ``selection`` has (neuron_idx, selection_score).
    """
    out = interpretations
    if selection is not None:
        out = out.join(
            selection.select("neuron_idx", "selection_score", F.lit(True).alias("selected")), "neuron_idx", "left"
        ).withColumn("selected", F.coalesce("selected", F.lit(False)))
    if method is not None:
        out = out.withColumn("selection_method", F.lit(method))
    out.write.mode("overwrite").parquet(path)
