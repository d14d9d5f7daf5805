"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage

# A key with more rows than this is spread over several tasks.
ROWS_PER_SALT = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], rows_per_salt: int | None = None) -> DataFrame:
    """Keys too large for one task and the number of salts each one needs.

    At most ``rows / rows_per_salt`` keys qualify, which bounds the size of this table.
    """
    return hot_from_counts(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, rows_per_salt
    )


def hot_from_counts(counts: DataFrame, keys: list[str], rows_per_salt: int | None = None) -> DataFrame:
    """Same as :func:`hot_keys` where the counts per key are at hand as ``_rows``."""
    rows_per_salt = rows_per_salt or ROWS_PER_SALT
    return counts.filter(F.col("_rows") > rows_per_salt).select(
        *keys, F.ceil(F.col("_rows") / rows_per_salt).cast("int").alias("_salts")
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread: Column | None = None,
    hot: DataFrame | None = None,
    n_left: int | None = None,
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Join where keys of ``left`` may be heavily skewed and ``right`` has few rows per key.

    Rows of hot keys get a salt derived from ``spread`` (default: a hash of the left row), the
    matching right rows are repeated once per salt, every other key is joined as usual. Rows
    with a null key match nothing, so a left join scatters them instead of sending them to one
    task. ``n_left`` is the number of left rows where known: if all of them fit one salt, no
    key can be hot and a plain join does.
    """
    rows_per_salt = rows_per_salt or ROWS_PER_SALT
    if n_left is not None and n_left <= rows_per_salt:
        return left.join(right, keys, how)
    if hot is None:
        hot = hot_keys(left.select(*keys), keys, rows_per_salt)
    hot = F.broadcast(hot)
    # Only map and variant columns cannot be hashed; no table of this library has them.
    row_hash = F.xxhash64(spread) if spread is not None else F.xxhash64(*left.columns)
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    salt = (
        F.when(null_key, -1 - F.pmod(row_hash, F.lit(4096)))
        .when(F.col("_salts").isNull(), F.lit(0))
        .otherwise(F.pmod(row_hash, F.col("_salts")))
    )
    salted_left = left.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def cached_split(tasks: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``tasks`` answered by a cache table and the rows that still need work."""
    known = cache.select(*keys).distinct()
    return tasks.join(known, keys, "left_semi"), tasks.join(known, keys, "left_anti")


def text_concept_tasks(texts: DataFrame, concepts: list[str]) -> DataFrame:
    """Every text with every concept; the concept list is part of the plan, not a join side."""
    listed = F.array(*[F.lit(c) for c in dict.fromkeys(concepts)])
    return texts.withColumn("concept", F.explode(listed)).withColumn(
        "concept_key", F.sha2("concept", 256)
    )


def texts_to_reannotate(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts for which at least one requested concept has no cached annotation.

    ``tasks`` has (text_key, concept_key), ``cache`` has (concept_key, text_key, annotation).
    """
    looked_up = tasks.join(
        cache.select("concept_key", "text_key", "annotation"), ["concept_key", "text_key"], "left"
    )
    return (
        looked_up.groupBy("text_key")
        .agg(F.bool_or(F.col("annotation").isNull()).alias("missing"))
        .filter("missing")
        .select("text_key")
    )


def response_deltas(
    pairs: DataFrame,
    embeddings: DataFrame,
    key_a: Column,
    key_b: Column,
    id: str = "row_id",
    materialised: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Difference of the two response vectors of each pair, next to the columns to ``keep``.

    ``embeddings`` has (text_key, embedding). Only ids and keys of the pairs are shuffled; a
    response repeated in a large share of the pairs is salted. Pairs without both vectors are
    dropped, see :func:`missing_embeddings`. ``materialised`` says that ``pairs`` holds ready
    keys in a checkpoint; otherwise the texts are read and hashed once into one.
    """
    keyed = pairs.select(id, *keep, key_a.alias("_a"), key_b.alias("_b"))
    if not materialised:
        keyed = cut_lineage(keyed)
    n = keyed.count()
    side_a = embeddings.select(F.col("text_key").alias("_a"), F.col("embedding").alias("_ea"))
    side_b = embeddings.select(F.col("text_key").alias("_b"), F.col("embedding").alias("_eb"))
    joined = skew_join(
        keyed, side_a, ["_a"], spread=F.col(id), hot=hot_keys(keyed.select("_a"), ["_a"]), n_left=n
    )
    joined = skew_join(
        joined, side_b, ["_b"], spread=F.col(id), hot=hot_keys(keyed.select("_b"), ["_b"]), n_left=n
    )
    return joined.select(id, *keep, F.zip_with("_ea", "_eb", lambda x, y: x - y).alias("delta"))


# A set of ids is broadcast up to this many.
BROADCAST_IDS = 2_000_000


def pick_rows(wide: DataFrame, ids: DataFrame, id: str = "row_id") -> DataFrame:
    """Rows of a wide table by id; ``ids`` should be materialised, as it is counted first.

    A sample small enough is sent to the wide scan, so that the rest of the table is neither
    shuffled nor processed any further; a larger one is joined as usual.
    """
    ids = ids.select(id).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return wide.join(ids, id, "left_semi")


def missing_embeddings(pairs: DataFrame, deltas: DataFrame, id: str = "row_id") -> DataFrame:
    """Pairs the inner joins of :func:`response_deltas` dropped."""
    return pairs.join(deltas.select(id), id, "left_anti")
