"""Finished steps of a job, kept so that a job that failed goes on where it stopped.

A step is a table whose folder is named by the step and a fingerprint of all that its rows follow from:
the sections of the configuration it reads and the tables it starts from. The folder appears under
its name only when it is complete, so a step is either there as a whole or made anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.sources.caches import _hadoop, table_exists


def fingerprint(*parts: Any) -> str:
    """Hash of values that JSON can hold; others count by their text."""
    text = json.dumps(parts, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def table_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """Hash of the rows of a table in any order, in one pass that keeps two numbers and a count."""
    first, second = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    n, a, b = df.agg(F.count(F.lit(1)), F.bit_xor(first), F.sum(second.cast("decimal(20,0)"))).first()
    return fingerprint(n, a, str(b))


def named(fn: Callable) -> str:
    return f"{getattr(fn, '__module__', '')}.{getattr(fn, '__qualname__', repr(fn))}"


class Steps:
    """Tables of finished steps below a folder; without a folder steps last as long as the session."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder

    def path(self, name: str, key: str) -> str | None:
        return f"{self.folder}/{name}-{key}" if self.folder else None

    def table(self, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(name, key)
        if path is None:
            return cut_lineage(build())
        if not table_exists(self.spark, path):
            made = f"{self.folder}/_{uuid.uuid4().hex}"
            rows = build()
            rows.write.parquet(made)
            fs, source = _hadoop(self.spark, made)
            if table_exists(self.spark, path) or not fs.rename(source, _hadoop(self.spark, path)[1]):
                fs.delete(source, True)  # another job was faster
            return self.spark.read.schema(rows.schema).parquet(path)
        return self.spark.read.parquet(path)
