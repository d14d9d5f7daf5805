"""Cutting the lineage of iterative jobs, and keeping results that must not be computed twice.

Results are written as Parquet tables to the shared folder named by ``spark.checkpoint.dir``, so
they survive the loss of any executor, and later jobs read only the columns they need. Only a
local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairlens-checkpoints-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return sc.getCheckpointDir()


@dataclass(frozen=True)
class Stored:
    """A table in the checkpoint folder."""

    rows: DataFrame
    path: str

    def discard(self) -> None:
        """Delete the table, once nothing will read it again."""
        spark = self.rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> Stored:
    """Write ``df`` to a table in the checkpoint folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the checkpoint folder and return a reader of that table."""
    return stored(df).rows
