"""From raw documents to packed training sequences: five stages, each a job of its own.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's documents. The first three drop documents, the
fourth repeats them as the mix takes them, the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm import line_rules, mixing, ngram_join, packing, toxicity_fm
from pairlens.llm.common import OWN, remainder
from pairlens.llm.queries import THRESHOLD


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are depleted; texts stay as they are."""
    return line_rules.drop_rejected(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic by a machine fitted on labelled rows outside the held-out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = toxicity_fm.train(docs, labels, ~held_out)
    scored = toxicity_fm.score(docs, model, out=OWN + "score")
    return scored.filter(F.col(OWN + "score") < THRESHOLD).drop(OWN + "score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of similar texts."""
    return ngram_join.one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as their source's target says: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences over all documents of the mix."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: The fitted machine, the random mix and the token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
