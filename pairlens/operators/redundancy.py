"""Redundancy among feature descriptions by cosine similarity of their vectors.

The closest other vector of each row, and the links above a threshold, are exact and found without
comparing all pairs. Unit vectors are points whose distance falls as their cosine rises, so the
triangle inequality rules pairs out. Pivots, taken from a bounded sample so that they lie apart, deal
the points into cells; a cell is cut by the distance from its pivot, and by a hash where distances are
equal, into blocks of bounded size. A block knows the range of distances of its points from every
pivot. Each block is first compared with itself, which bounds how far the closest partners of its
points can be; two blocks meet only if their ranges allow a pair within that bound or the
threshold, and in their task only points whose own bound allows it are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import list_column, matrix_of
from pairlens.lineage import cut_lineage
from pairlens.operators.split import component_of_edges

BLOCK_ROWS = 4096  # vectors of a block
MOST_BLOCKS = 20_000  # beyond, blocks grow, so that one row per block fits the driver
PIVOTS, SAMPLE_ROWS = 64, 4096
CHUNK_ROWS = 1024  # rows compared with a block at once
SLACK = 1e-6  # rounding of distances

FOUND = "kind int, id long, partner long, similarity double"


def _unit_rows(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def spread_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the unit rows, each the one farthest from those before."""
    if not len(x):
        return x
    chosen = [0]
    far = _distance(x @ x[0])
    while len(chosen) < n and far.max() > 1e-3:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(x @ x[chosen[-1]]))
    return x[chosen]


@dataclass(frozen=True)
class Index:
    """Pivots, and the blocks' ranges of distances from them (block numbers are positions)."""

    pivots: np.ndarray
    names: list[str]
    low: np.ndarray
    high: np.ndarray

    def gap(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest distance that ranges allow to any point of each block."""
        return np.maximum(low - self.high, self.low - high).max(axis=-1)


def _compare(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], threshold: float
) -> Iterator[tuple]:
    """Columns of FOUND: each left row's closest right row (kind 0), links that span those above the
    threshold (kind 1), and the number of comparisons (kind 2). Ids ascend on both sides; a row's
    similarity to itself counts as 0."""
    (left_ids, x), (right_ids, y) = left, right
    parent = {int(i): int(i) for i in (*left_ids, *right_ids)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for at in range(0, len(left_ids), CHUNK_ROWS):
        ids = left_ids[at : at + CHUNK_ROWS]
        sims = x[at : at + CHUNK_ROWS] @ y.T
        place = np.minimum(np.searchsorted(right_ids, ids), len(right_ids) - 1)
        itself = np.flatnonzero(right_ids[place] == ids)
        sims[itself, place[itself]] = 0.0
        best = sims.argmax(axis=1)
        yield np.zeros(len(ids), np.int32), ids, right_ids[best], sims[np.arange(len(ids)), best]
        above = sims > threshold
        above[itself, place[itself]] = False
        for row in np.flatnonzero(above.any(axis=1)).tolist():
            own = root(int(ids[row]))
            for other in right_ids[above[row]].tolist():
                theirs = root(other)
                if theirs != own:
                    links.append((int(ids[row]), other))
                    parent[theirs] = own
    if links:
        u, v = map(np.array, zip(*links))
        yield np.ones(len(u), np.int32), u, v, np.full(len(u), np.nan)
    yield np.full(1, 2, np.int32), np.full(1, -1), np.full(1, -1), np.full(1, float(len(left_ids) * len(right_ids)))


def _table(parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, t) for t in ("i4", "i8", "i8", "f8")]
    return pa.table(columns, names=["kind", "id", "partner", "similarity"])


def _points(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, unit vectors, order) of a group, by ascending id."""
    ids = group.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix_of(group.column("embedding"))[order], order


def _within(blocks: DataFrame, threshold: float) -> DataFrame:
    """Each block with itself."""

    def run(group: pa.Table) -> pa.Table:
        ids, x, _ = _points(group)
        return _table(list(_compare((ids, x), (ids, x), threshold)))

    return blocks.select("block", "id", "embedding").groupBy("block").applyInArrow(run, FOUND)


def _sample(points: DataFrame, n: int, rows: int) -> np.ndarray:
    """About ``rows`` points, chosen by a hash of the id."""
    bound = int(2**63 * min(1.0, rows / max(n, 1))) - 1
    chosen = points.filter(F.xxhash64(F.lit(5), "id").bitwiseAND(2**63 - 1) <= F.lit(bound))
    table = chosen.select("id", "embedding").toArrow()
    return matrix_of(table.column(1))[np.argsort(table.column(0).to_numpy())] if table.num_rows else np.zeros((0, 0))


def _in_blocks(points: DataFrame, n: int, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """(id, embedding, block) with blocks of about ``block_rows`` rows."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distance(matrix_of(batch.column(1)) @ pivots.T)
                cell = far.argmin(axis=1)
                ring = far[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(ring)], names=["id", "embedding", "cell", "ring"]
                )

    celled = cut_lineage(points.mapInArrow(assign, "id long, embedding array<double>, cell int, ring double"))
    # One row per pivot, then one per ring: both bounded by the number of blocks.
    cuts = F.least(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(MOST_BLOCKS)).cast("int")
    shares = [i / 64 for i in range(1, 64)]
    cells = celled.groupBy("cell").agg(cuts.alias("n_rings"), F.percentile_approx("ring", shares, 10_000).alias("q"))
    bounds = F.transform(
        F.sequence(F.lit(1), F.greatest(F.least("n_rings", F.lit(64)) - 1, F.lit(1))),
        lambda i: F.element_at("q", F.greatest(F.floor(i * 64 / F.least("n_rings", F.lit(64))), F.lit(1)).cast("int")),
    )
    cells = cells.select("cell", F.when(F.col("n_rings") > 1, bounds).otherwise(F.array().cast("array<double>")).alias("bounds"))
    ringed = celled.join(F.broadcast(cells), "cell").select(
        "id", "embedding", "cell", F.size(F.filter("bounds", lambda b: b < F.col("ring"))).alias("nth")
    )
    rings = ringed.groupBy("cell", "nth").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(9), "id"), F.col("parts"))
    return ringed.join(F.broadcast(rings), ["cell", "nth"]).select(
        "id", "embedding", F.concat_ws("-", "cell", "nth", part).alias("block")
    )


def _index(blocks: DataFrame, pivots: np.ndarray) -> Index:
    k = len(pivots)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distance(matrix_of(batch.column(1)) @ pivots.T)
                names, code = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                low, high = np.full((len(names), k), np.inf), np.full((len(names), k), -np.inf)
                np.minimum.at(low, code, far)
                np.maximum.at(high, code, far)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(k, dtype=np.int32), len(names))), pa.array(low.ravel()), pa.array(high.ravel())],
                    names=["block", "pivot", "low", "high"],
                )

    found = (
        blocks.select("block", "embedding")
        .mapInArrow(ranges, "block string, pivot int, low double, high double")
        .groupBy("block", "pivot")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .orderBy("block", "pivot")
        .toArrow()  # a row per block and pivot
    )
    shape = (-1, k)
    low, high = (found.column(c).to_numpy().reshape(shape) for c in ("low", "high"))
    return Index(pivots, found.column("block").to_pylist()[::k], low, high)


def _across(blocks: DataFrame, found: DataFrame, index: Index, threshold: float) -> DataFrame:
    """Blocks that may hold closer partners or links for each other."""
    spark = blocks.sparkSession
    reach = float(_distance(np.array(threshold)))
    bound = F.greatest(F.sqrt(F.greatest(2 - 2 * F.coalesce("similarity", F.lit(0.0)), F.lit(0.0))), F.lit(reach)) + SLACK
    best = found.filter("kind = 0").select("id", bound.alias("bound"))
    bounded = cut_lineage(blocks.join(best, "id"))
    # One number per block.
    widest = {r["block"]: r["widest"] for r in bounded.groupBy("block").agg(F.max("bound").alias("widest")).collect()}
    wide = np.array([widest[name] for name in index.names])
    names = index.names

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gap = index.gap(index.low[i], index.high[i])
                near = np.flatnonzero(gap[i + 1 :] <= np.maximum(wide[i], wide[i + 1 :])) + i + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), i, np.int32)), pa.array(near.astype(np.int32))], names=["first", "other"]
                )

    tasks = max(spark.sparkContext.defaultParallelism, len(names) // 100)
    meeting = cut_lineage(spark.range(0, len(names), 1, tasks).mapInArrow(pairs, "first int, other int"))
    numbers = spark.createDataFrame(list(enumerate(names)), "number int, block string")
    rows = bounded.join(F.broadcast(numbers), "block").select("id", "embedding", "bound", "number")
    sides = [
        rows.join(meeting, rows["number"] == meeting[side]).select("id", "embedding", "bound", "number", "first", "other")
        for side in ("first", "other")
    ]

    def run(group: pa.Table) -> pa.Table:
        ids, x, order = _points(group)
        number, limit = group.column("number").to_numpy()[order], group.column("bound").to_numpy()[order]
        far = _distance(x @ index.pivots.T)
        parts = []
        first, other = group.column("first")[0].as_py(), group.column("other")[0].as_py()
        for mine, theirs in ((first, other), (other, first)):
            near = np.maximum(far - index.high[theirs], index.low[theirs] - far).max(axis=1) <= limit
            asking, asked = near & (number == mine), number == theirs
            if asking.any():
                parts += _compare((ids[asking], x[asking]), (ids[asked], x[asked]), threshold)
        return _table(parts)

    return sides[0].unionByName(sides[1]).groupBy("first", "other").applyInArrow(run, FOUND)


def compare_vectors(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Comparison of (id, embedding) with itself, without vectors of length zero: rows of FOUND."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit_rows(matrix_of(batch.column(1)))
            kept = np.flatnonzero(x.any(axis=1)) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), list_column(x[kept], pa.float64())], names=["id", "embedding"]
            )

    read = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda v: v.cast("double")))
    points = cut_lineage(read.mapInArrow(units, "id long, embedding array<double>"))
    n = points.count()
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    if n <= block_rows:
        return cut_lineage(_within(points.withColumn("block", F.lit("all")), threshold))
    pivots = spread_pivots(_sample(points, n, SAMPLE_ROWS), PIVOTS)
    if not len(pivots):
        pivots = matrix_of(points.limit(1).toArrow().column("embedding"))
    blocks = cut_lineage(_in_blocks(points, n, pivots, block_rows))
    found = cut_lineage(_within(blocks, threshold))
    return found.unionByName(cut_lineage(_across(blocks, found, _index(blocks, pivots), threshold)))


def redundancy(concepts: DataFrame, threshold: float = 0.7, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Closest other concept per row, and the number of components of similar concepts.

    ``concepts`` has (id, text, embedding). Returns (id, semantic_redundancy,
    semantic_neighbor). A row counts as its own neighbour with similarity 0, so the redundancy is
    never negative; so does a vector of length zero for every row. The smallest id wins ties. Without
    rows the table is empty and there are 0 components.
    """
    compared = compare_vectors(concepts, threshold, block_rows)
    ids = concepts.select(F.col("id").cast("long").alias("id"))
    has_length = compared.filter("kind = 0").select("id").distinct()
    zeros = cut_lineage(ids.join(has_length, "id", "left_anti"))
    first_zero = zeros.agg(F.min("id")).first()[0]
    first = ids.agg(F.min("id")).first()[0]
    candidates = compared.filter("kind = 0").drop("kind").unionByName(
        zeros.select("id", F.lit(first).cast("long").alias("partner"), F.lit(0.0).alias("similarity"))
    )
    if first_zero is not None:
        candidates = candidates.unionByName(
            has_length.select("id", F.lit(first_zero).cast("long").alias("partner"), F.lit(0.0).alias("similarity"))
        )
    closest = candidates.groupBy("id").agg(
        F.max_by(F.struct("similarity", "partner"), F.struct("similarity", -F.col("partner"))).alias("best")
    ).select("id", F.col("best.similarity").alias("_s"), F.col("best.partner").alias("_p"))
    texts = concepts.select(F.col("id").cast("long").alias("_p"), F.col("text").alias("semantic_neighbor"))
    table = (
        ids.join(closest, "id", "left")
        .join(texts, "_p", "left")
        .select("id", F.col("_s").alias("semantic_redundancy"), "semantic_neighbor")
    )
    links = compared.filter("kind = 1").select(F.col("id").alias("u"), F.col("partner").alias("v"))
    if threshold < 0 and first_zero is not None:  # similarity 0 is then a link to every row
        links = links.unionByName(ids.filter(F.col("id") != first_zero).select(F.col("id").alias("u"), F.lit(first_zero).cast("long").alias("v")))
    grouped = component_of_edges(links)
    linked, components = grouped.agg(F.count(F.lit(1)), F.count_distinct("component")).first()
    return table, concepts.count() - linked + components
