"""From a preference table to split, filtered and deduplicated rows and their deltas.

The texts are read once into a narrow table of ids, labels and 32-byte keys. Splitting,
deduplication and delta joins run on that table; wide rows are only touched again to embed
distinct texts and to show sampled examples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.config import DatasetConfig, RuntimeConfig
from pairlens.functions.text import pairwise_text, text_key
from pairlens.lineage import cut_lineage
from pairlens.operators.completion import Embedder
from pairlens.operators.dedup import dedup_unordered_pairs, unique_texts
from pairlens.operators.embed import embed_texts
from pairlens.operators.joins import pick_rows, response_deltas
from pairlens.operators.ordered import cap_rows
from pairlens.operators.split import component_split
from pairlens.operators.stats import is_binary_label
from pairlens.sources.loader import load_preferences, with_length_delta

DEBUG_ROWS = 10_000
SUBSETS = ("train", "val", "train_pred", "val_pred", "dedup_train", "dedup_val")


def in_subset(subset: str) -> Column:
    """Condition on the membership columns split, binary and dedup."""
    if subset not in SUBSETS:
        raise KeyError(subset)
    side = F.col("split") == ("val" if "val" in subset else "train")
    if subset.endswith("_pred"):
        return side & F.col("binary")
    return side & F.col("dedup") if subset.startswith("dedup_") else side


@dataclass
class Preprocessed:
    """All rows, and which of the six working subsets each belongs to.

    ``members`` is checkpointed: (row_id, label, controls..., key_a, key_b, split, binary,
    dedup). ``binary`` marks 0/1 labels, ``dedup`` the row kept of each unordered response pair
    within its split.
    """

    rows: DataFrame
    members: DataFrame

    def narrow(self, subset: str) -> DataFrame:
        """Members of ``train``, ``val``, ``train_pred``, ``val_pred``, ``dedup_train`` or ``dedup_val``."""
        return self.members.filter(in_subset(subset))

    def wide(self, subset: str) -> DataFrame:
        """Full rows of a subset."""
        return self.rows.join(self.narrow(subset).select("row_id"), "row_id", "left_semi")

    def subsets(self) -> DataFrame:
        """(subset, row_id) of all six."""
        names = F.array(
            F.col("split"),
            F.when(F.col("binary"), F.concat("split", F.lit("_pred"))),
            F.when(F.col("dedup"), F.concat(F.lit("dedup_"), "split")),
        )
        listed = self.members.select("row_id", F.explode(names).alias("subset"))
        return listed.filter(F.col("subset").isNotNull()).select("subset", "row_id")


def preprocess(
    df: DataFrame, cfg: DatasetConfig, debug: bool = False, controls: tuple[str, ...] = ("length_delta",)
) -> Preprocessed:
    """Split without leakage, mark binary labels and mirrored pairs.

    The outcome is checkpointed: it decides what is trained on, and later jobs must all see the
    same one.
    """
    if debug:
        df = cap_rows(df, DEBUG_ROWS, cfg.random_seed)
    df = with_length_delta(df)
    split_keys = {f"_split{i}": F.sha2(F.col(c).cast("string"), 256) for i, c in enumerate(cfg.split_on)}
    narrow = cut_lineage(
        df.select(
            "row_id",
            "label",
            *dict.fromkeys(controls),
            text_key(F.col("response_A")).alias("key_a"),
            text_key(F.col("response_B")).alias("key_b"),
            *[key.alias(name) for name, key in split_keys.items()],
        )
    )
    sides = component_split(narrow, list(split_keys), cfg.train_split_size, cfg.split_random_seed)
    placed = cut_lineage(
        narrow.drop(*split_keys)
        .join(sides.select("row_id", "split"), "row_id")
        .withColumn("binary", is_binary_label(F.col("label")))
    )
    kept = dedup_unordered_pairs(placed, "key_a", "key_b", within=["split"]).select(
        "row_id", F.lit(True).alias("dedup")
    )
    members = placed.join(kept, "row_id", "left").withColumn("dedup", F.coalesce("dedup", F.lit(False)))
    return Preprocessed(df, cut_lineage(members))


def load_and_preprocess(
    spark: SparkSession, cfg: DatasetConfig, runtime: RuntimeConfig | None = None,
    controls: tuple[str, ...] = ("length_delta",),
) -> Preprocessed:
    extra = (*cfg.split_columns, *[c for c in controls if c != "length_delta"])
    df = load_preferences(spark, cfg.path, columns=cfg.columns, extra=extra)
    return preprocess(df, cfg, bool(runtime and runtime.debug), controls)


@dataclass
class Embedded:
    """Vectors per distinct response, and the checkpointed delta of every row.

    Labels, controls and membership ride along with the deltas, so picking a subset never
    shuffles vectors again.
    """

    embeddings: DataFrame  # (text_key, embedding)
    deltas: DataFrame  # (row_id, label, controls..., split, binary, dedup, delta)

    @property
    def riders(self) -> tuple[str, ...]:
        return tuple(c for c in self.deltas.columns if c not in ("row_id", "delta"))

    def of(self, subset: str) -> DataFrame:
        return self.deltas.filter(in_subset(subset))


def deltas_of(df: DataFrame, embeddings: DataFrame) -> DataFrame:
    return response_deltas(
        df, embeddings, text_key(F.col("response_A")), text_key(F.col("response_B"))
    )


def embed_responses(
    data: Preprocessed, embedder: Embedder, model: str, cache_path: str | None = None, concurrency: int | None = None
) -> Embedded:
    """Embed every distinct response once and form the delta of every row.

    Each row is in one split, so the texts come straight from the source rows.
    """
    texts = unique_texts(data.rows, F.col("response_A"), F.col("response_B"))
    return deltas_for(data, embed_texts(texts, embedder, model, cache_path, concurrency=concurrency))


def deltas_for(data: Preprocessed, embeddings: DataFrame) -> Embedded:
    riders = tuple(c for c in data.members.columns if c not in ("row_id", "key_a", "key_b"))
    deltas = response_deltas(
        data.members, embeddings, F.col("key_a"), F.col("key_b"), materialised=True, keep=riders
    )
    return Embedded(embeddings, cut_lineage(deltas))


def pair_texts(df: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """(row_id, text): rendered comparison, truncated as configured."""
    return df.select(
        "row_id",
        pairwise_text(
            F.col("prompt"), F.col("response_A"), F.col("response_B"), True,
            cfg.max_words_prompt, cfg.max_words_response,
        ).alias("text"),
    )


def sampled_pair_texts(rows: DataFrame, samples: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Rendered comparisons of the sampled ids only."""
    return pair_texts(pick_rows(rows, samples), cfg)
