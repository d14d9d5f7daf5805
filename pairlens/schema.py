"""Column names and types of the tables the library reads and writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnNames:
    """Names a user's preference table gives to the required columns."""

    prompt: str = "prompt"
    response_a: str = "response_A"
    response_b: str = "response_B"
    label: str = "label"


PREFERENCES = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("response_A", T.StringType()),
        T.StructField("response_B", T.StringType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("length_delta", T.LongType()),
    ]
)

EMBEDDING_CACHE = T.StructType(
    [
        T.StructField("text_key", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model", T.StringType()),
    ]
)

ANNOTATION_CACHE = T.StructType(
    [
        T.StructField("concept_key", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("annotation", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_name", T.StringType()),
    ]
)

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
