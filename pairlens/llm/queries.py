"""The registered queries: each applies one operator, with production parameters, to its table."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import (
    cross_polytope, elias_fano, importance, katz, line_rules, mixing, ngram_join, packing, style_tree, token_counts,
    toxicity_fm, turn_repair, word_table,
)
from pairlens.llm.common import remainder
from pairlens.llm.registry import query, table
from pairlens.llm.sql import IMPORTANCE, REPAIR

THRESHOLD = 0.3


@query()
def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", *line_rules.LINE_MEASURES, "base_failed", "kept", "n_common_lines", "n_common_words"
    )


@query()
def op9_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = toxicity_fm.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity_fm.score(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@query()
def op2_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = elias_fano.shard_folder(docs)
    manifest = elias_fano.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return elias_fano.read_shards(manifest, folder)


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op10_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


@query()
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


@query()
def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = style_tree.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query()
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = katz.score_documents(docs, remainder("doc_id", 5) != 1)
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query(REPAIR)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")))


def _digests(ids: np.ndarray, pieces: list[str]) -> tuple[int, str, str]:
    wide = ids.astype("<u4").tobytes()
    return len(ids), hashlib.sha256(wide).hexdigest(), hashlib.sha256(" ".join(pieces).encode()).hexdigest()


@query()
def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return word_table.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"), _digests, schema)


@query(IMPORTANCE)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
