"""Token counts of whole texts, without keeping any ids.

An Arrow batch is worked off in groups of about a million bytes; a longer text is a group of its
own and is cut at safe boundaries. Only lengths leave the worker.

Defined results: null and empty texts have 0 bytes and 0 tokens; ids may be null or repeated and
pass through; tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import OWN, whole
from pairlens.llm.tokens import balanced, encoder

TEXT = OWN + "text"


def library_counts(path: str, blanks: str, texts: list[str]) -> list[int]:
    """Numbers of tokens by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
        return [len(x) for x in found]
    enc = encoder(path, blanks)
    return [len(x) // enc.dtype.itemsize for x in enc.encode(texts)]


def count_tokens(
    docs: DataFrame, tokenizer: str, blanks: str = "kept", text: str = "text", limit: int = 1024
) -> DataFrame:
    """The columns of ``docs`` but the text, with n_bytes, n_tokens and over_limit."""
    names = [c for c in docs.columns if c != text]
    ready = docs.select(*names, whole(F.col(text)).alias(TEXT))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*docs.select(*names).schema.fields, *added])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            texts = column.to_pylist()
            counts: list[int] = []
            for a, b in balanced(texts):
                counts += library_counts(tokenizer, blanks, texts[a:b])
            sizes = pa.compute.binary_length(column).cast(pa.int64())
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*kept, sizes, pa.array(counts, pa.int64())], names=[*names, "n_bytes", "n_tokens"]
            )

    return ready.mapInArrow(over, schema).withColumn("over_limit", F.col("n_tokens") > limit)
