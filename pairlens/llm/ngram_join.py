"""N-gram Jaccard join by MinHash banding, with verification on full n-gram sets.

A text is the set of its five-word shingles (a text of fewer words is one shingle of its own). Texts
of equal sets form a node with a number of copies, so copies are never compared. Band and row counts
follow from the threshold and a target recall. Bands are shuffled on their hashes; only buckets of
two nodes or more go on.

Buckets are compared without listing their pairs. Every node has a home, the largest bucket that it
or another member of one of its buckets is in, and large homes are cut into blocks of about
``block_nodes`` nodes and ``block_shingles`` shingles by hash. Blocks that meet in some bucket make
a block pair, compared once, in one task, by pair counts of rare shingles and matrix products of
frequent ones. A node is in one block only, so no pair of nodes is seen twice. A task returns, per
node, the number of linked documents and one edge of a spanning forest.

Defined results: null and blank texts have no shingles, link with nothing and are classes of their
own; classes are named after their smallest id; null ids stay null and name a class only if it has
no other; repeated rows are copies. Whole texts are used, of any length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import KEY, OWN, with_key
from pairlens.operators.split import component_of_edges

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def bands_for(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold in so many hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall; allow more hashes")
    return best


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


word_hashes = _WordHashes()


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles of a text in ascending order."""
    words = (text or b"").split()  # splits bytes at ASCII blanks
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    return np.unique(mixed_windows(w, np.arange(len(w) - k + 1), k))


def mixed_windows(w: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words that begin at ``at``, from the hashes of words."""
    h = np.full(len(at), np.uint64(k))
    for i in range(k):
        h = h * STEP + w[at + i]
        h ^= h >> np.uint64(29)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(s), 2048):
            part = s[at : at + 2048]
            np.minimum(low, (part[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1), out=low)
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * MIX
        for column in low.reshape(self.bands, self.rows).T:
            h = (h ^ (column >> np.uint64(7))) * STEP
            h ^= h >> np.uint64(31)
        return h.view(np.int64)


def sign(docs: DataFrame, id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(key, id, node, n_shingles, bands) per row; node is null for texts without words."""
    schema = f"{KEY[0]} bigint, {KEY[1]} bigint, id bigint, node binary, n_shingles int, bands array<bigint>"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in batches:
            nodes, sizes, signed = [], [], []
            for text in batch.column(3).to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signed.append(signer(s) if len(s) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, signed)]).astype(np.int32)
            values = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=[*KEY, "id", "node", "n_shingles", "bands"],
            )

    keyed = with_key(docs.select(id, text), id, text)
    return keyed.select(*KEY, F.col(id).cast("long"), F.col(text).cast("binary")).mapInArrow(over, schema)


# Shingles of up to so many sets are counted pair by pair, the others by matrix products.
RARE = 64
WIDTH = 2048


def common_counts(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Numbers of shingles that the first ``n_left`` sets share with the rest, or, where there is
    no rest, with each other. Sets are ascending and without repetitions."""
    within = n_left == len(sets)
    first = 0 if within else n_left
    common = np.zeros((n_left, len(sets) - first), dtype=np.float32)
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    if not len(values):
        return common
    column = np.cumsum(np.r_[True, values[1:] != values[:-1]]) - 1
    holders = np.bincount(column)[column]

    rare = (holders > 1) & (holders <= RARE)
    own, col = owner[rare], column[rare]
    for step in range(1, RARE):
        if step >= len(col):
            break
        a, b = own[:-step], own[step:]
        both = col[:-step] == col[step:]
        if not within:
            both &= (a < n_left) & (b >= n_left)
        if not both.any():
            if not (col[:-step] == col[step:]).any():
                break
            continue
        np.add.at(common, (a[both], b[both] - first), 1.0)
        if within:
            np.add.at(common, (b[both], a[both]), 1.0)

    frequent = holders > RARE
    own, col = owner[frequent], column[frequent]
    col = np.cumsum(np.r_[True, col[1:] != col[:-1]]) - 1 if len(col) else col
    for start in range(0, (int(col[-1]) + 1) if len(col) else 0, WIDTH):
        a, b = np.searchsorted(col, [start, start + WIDTH])
        member = np.zeros((len(sets), WIDTH), dtype=np.float32)
        member[own[a:b], col[a:b] - start] = 1.0
        common += member[:n_left] @ member[first:].T
    return common


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with a Jaccard similarity of at least ``threshold``, between two
    lists of sets or, without ``right``, within one, where no set pairs with itself."""
    common = common_counts([*left, *(right or [])], len(left))
    rows = np.array([len(s) for s in left], dtype=np.float32)
    columns = rows if right is None else np.array([len(s) for s in right], dtype=np.float32)
    union = rows[:, None] + columns[None, :] - common
    linked = (common > 0) & (common >= (threshold - 1e-6) * union)
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def compare_blocks(group: pa.Table, threshold: float, n: int) -> pa.Table:
    """Links of a block pair: (node, links, root) of every node with a link."""
    blocks = np.array(group.column("block").to_pylist(), dtype=np.int64)
    nodes = group.column("node").to_pylist()
    copies = np.array(group.column("copies").to_pylist(), dtype=np.int64)
    sets = [shingles(t, n) for t in group.column("text").to_pylist()]
    first, last = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    alone = blocks.min() == blocks.max()
    linked = similar_pairs([sets[i] for i in first], None if alone else [sets[i] for i in last], threshold)
    links = np.zeros(len(nodes), dtype=np.int64)
    links[first] += linked @ copies[last]
    if not alone:
        links[last] += linked.T @ copies[first]
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, row in zip(first, linked):
        for j in last[row]:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    some = np.flatnonzero(links)
    return pa.table(
        {
            "node": pa.array([nodes[i] for i in some], pa.binary()),
            "links": pa.array(links[some]),
            "root": pa.array([nodes[find(i)] for i in some], pa.binary()),
        }
    )


def jaccard_classes(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    n: int = SHINGLE,
    block_nodes: int = 2048,
    block_shingles: int = 1 << 19,
) -> DataFrame:
    """One row per row of ``docs``: key, id, class_id, n_links (documents of similarity
    ``threshold`` or more, copies included), n_copies (documents of an equal set, itself too) and
    class_key, which tells classes of equal or null ids apart and is null for texts without words."""
    bands, rows = bands_for(threshold, recall)
    signed = cut_lineage(sign(docs, id, text, n, bands, rows))
    nodes = cut_lineage(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("id").alias("min_id"),
            F.min(F.struct(*KEY, "n_shingles", "bands")).alias("rep"),
        )
        .select("node", "copies", "min_id", *[F.col("rep")[k].alias(k) for k in (*KEY, "n_shingles", "bands")])
    )
    held = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = (
        held.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
    )
    members = cut_lineage(held.join(buckets, "bucket"))
    largest = members.groupBy("node").agg(F.max(F.struct("m", "bucket")).alias("home"))
    # Nodes follow the members of their buckets into a larger home, so a group has few homes.
    drawn = members.join(largest, "node").groupBy("bucket").agg(F.max("home").alias("home"))
    settled = cut_lineage(
        members.join(drawn, "bucket").groupBy("node").agg(F.max("home").alias("home"), F.max("n_shingles").alias("n_shingles"))
    )
    sizes = settled.groupBy("home").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("weight"))
    parts = F.greatest(F.ceil(F.col("rows") / block_nodes), F.ceil(F.col("weight") / block_shingles))
    homes = cut_lineage(
        settled.join(sizes, "home").select(
            "node", F.xxhash64("home.bucket", F.pmod(F.xxhash64("node"), parts)).alias("block")
        )
    )
    met = members.select("node", "bucket").join(homes, "node").select("bucket", "block").distinct()
    pairs = (
        met.join(met.withColumnRenamed("block", "other"), "bucket")
        .filter("block <= other")
        .select("block", "other")
        .distinct()
    )
    pair = F.struct("block", "other")
    sides = F.explode(F.array_distinct(F.array("block", "other"))).alias("side")
    texts = (
        with_key(docs.select(id, text), id, text)
        .join(nodes.select(*KEY, "node", "copies").join(homes, "node"), KEY)
        .select("node", "copies", "block", F.col(text).cast("binary").alias("text"))
        .dropDuplicates(["node"])
    )
    work = pairs.select(pair.alias("pair"), sides).join(texts.withColumnRenamed("block", "side"), "side")
    compared = cut_lineage(
        work.select("pair.*", "node", "copies", "text", F.col("side"))
        .withColumnRenamed("block", "_first")
        .withColumnRenamed("side", "block")
        .groupBy("_first", "other")
        .applyInArrow(lambda g: compare_blocks(g, threshold, n), "node binary, links bigint, root binary")
    )
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    edges = compared.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    component = component_of_edges(edges)
    named = component.join(nodes.select("node", "min_id"), "node")
    names = named.groupBy("component").agg(F.min("min_id").alias("class_id"))
    classes = (
        nodes.select("node", "copies", "min_id")
        .join(links, "node", "left")
        .join(named.join(names, "component").select("node", "component", "class_id"), "node", "left")
        .select(
            "node",
            "copies",
            F.coalesce("component", "node").alias("class_key"),
            F.coalesce("class_id", "min_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return (
        signed.select(*KEY, "id", "node")
        .join(cut_lineage(classes), "node", "left")
        .select(
            *KEY,
            F.col("id").alias(id),
            F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
            "class_key",
        )
    )


def one_per_class(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the smallest id of each class."""
    classes = cut_lineage(jaccard_classes(docs, id, text, **options))
    # Equal texts have one hash per id, so the smallest key of a class is one document's.
    full = classes.filter(F.col("class_key").isNotNull())
    first = full.groupBy("class_key").agg(F.min(F.struct(*KEY)).alias("_first"))
    named = full.join(first, "class_key").select(*KEY, "_first")
    dropped = cut_lineage(named.filter(F.struct(*KEY) != F.col("_first")).select(*KEY).distinct())
    repeated = cut_lineage(full.groupBy(*KEY).count().filter("count > 1").select(*KEY))
    keyed = with_key(docs, id, text)
    # The dropped keys grow with the table: a shuffle at every size, never a broadcast.
    kept = keyed.join(dropped.hint("merge"), KEY, "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, KEY, "left_semi").dropDuplicates(KEY)
        kept = kept.join(repeated, KEY, "left_anti").unionByName(once)
    return kept.drop(*KEY)
