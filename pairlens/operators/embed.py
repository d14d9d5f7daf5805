"""Embedding each distinct text once, through a cache table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.text import is_valid_text
from pairlens.functions.vectors import list_column
from pairlens.lineage import cut_lineage
from pairlens.operators.completion import Embedder
from pairlens.operators.joins import cached_split
from pairlens.schema import EMBEDDING_CACHE
from pairlens.sources.caches import append_bucketed, bucketed_table


def embed_missing(
    texts: DataFrame, embedder: Embedder, batch_size: int = 128, concurrency: int | None = None
) -> DataFrame:
    """(text_key, embedding) of every row of (text_key, text); ``concurrency`` bounds the tasks that call
    the embedder at the same time."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                matrix = np.asarray(embedder(part.column(1).to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_column(matrix, pa.float32())], names=["text_key", "embedding"]
                )

    selected = texts.select("text_key", "text")
    if concurrency is not None:
        selected = selected.repartition(concurrency)
    return selected.mapInArrow(run, "text_key string, embedding array<float>")


def embed_texts(
    texts: DataFrame, embedder: Embedder, model: str, cache_path: str | None = None, batch_size: int = 128,
    concurrency: int | None = None,
) -> DataFrame:
    """(text_key, embedding) for distinct (text_key, text) rows; null and blank texts drop out.

    With a cache table only texts it lacks are embedded and appended. Without one the vectors
    are checkpointed, so that the embedder runs once per text either way.
    """
    wanted = texts.filter(is_valid_text(F.col("text")))
    if cache_path is None:
        return cut_lineage(embed_missing(wanted, embedder, batch_size, concurrency))
    spark = texts.sparkSession
    table = (cache_path, EMBEDDING_CACHE, "text_key")
    _, misses = cached_split(wanted, bucketed_table(spark, *table, model=model), ["text_key"])
    # Made and kept before the table grows: it must not read what it is about to add to.
    append_bucketed(cut_lineage(embed_missing(misses, embedder, batch_size, concurrency)), *table, model=model)
    cache = bucketed_table(spark, *table, model=model)
    # Two jobs sharing the table may both have added a text; one vector per key is kept.
    return cache.join(wanted.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])
