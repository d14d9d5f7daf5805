"""The full job for every configuration in a folder, in one session."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from pairlens.config import load_config
from pairlens.operators.completion import Completer, Completers, Embedder
from pairlens.plans.features import run_job
from pairlens.sources.sinks import write_job_result

METRICS = "dataset string, metric string, value double, error string"


def run_sweep(
    spark: SparkSession, config_dir: str, out_dir: str, embedder: Embedder, completer: Completer | Completers,
    parallel: int = 4,
) -> DataFrame:
    """Write each job's tables under ``out_dir`` and return (dataset, metric, value, error) of all.

    Up to ``parallel`` jobs run at a time, each in a scheduler pool of its own. A job that fails is one
    row with the metric ``failed`` and its error; the others go on.
    """

    def one(path: Path) -> list[tuple]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", path.stem)
        try:
            result = run_job(spark, load_config(str(path)), embedder, completer)
            write_job_result(result, out_dir, prefix=f"{path.stem}_")
            metrics = result.summary.unionByName(result.selections.aucs).select("metric", "value")
            # A handful of numbers per job.
            return [(path.stem, r["metric"], r["value"], None) for r in metrics.collect()]
        except Exception as error:  # reported as a row
            return [(path.stem, "failed", None, f"{type(error).__name__}: {error}")]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    paths = sorted(Path(config_dir).glob("*.json"))
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        # Each thread starts with the local properties of this one.
        rows = [row for part in pool.map(inheritable_thread_target(one), paths) for row in part]
    return spark.createDataFrame(rows, METRICS)
