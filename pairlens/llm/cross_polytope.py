"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and falls to the nearest signed axis; ``parts`` such axes together name its bucket in
one table. A query probes, in every table, the buckets whose axes are next nearest. All vectors of
the probed buckets are candidates and are ranked by exact distance in double precision.

Queries and vectors of a bucket meet in one task, which returns the best ``k`` per query only, so
no list of candidates is ever shuffled. Buckets above ``block_rows`` are split by a hash of the id
and their queries go to every part. The number of parts of a bucket name grows with the logarithm
of the number of vectors, which holds the mean bucket near ``bucket_rows``. A query that finds
fewer than ``k`` is searched in all blocks of the table, so every query gets all there is.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without
id, take no part; only vectors of equal length are compared, by their first row's ids if ids repeat
(the nearest counts); equal distances go to the smaller id; tables without rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.lineage import cut_lineage

ROUNDS = 3
#: (tables, probes) by the number of axes that name a bucket. Recall of the ten nearest among 50 000
#: Gaussian vectors of 64 dimensions, which have no structure to help, and the share of vectors looked
#: at: 0.999 and 0.64, 0.946 and 0.17, 0.960 and 0.10.
SEARCH = {1: (20, 8), 2: (20, 128), 3: (30, 4096)}


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    width = 1
    while width < d:
        x = x.reshape(n, d // (2 * width), 2, width)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        width *= 2
    return x / math.sqrt(d)


class Hasher:
    """Bucket names of unit vectors in all tables."""

    def __init__(self, length: int, tables: int, parts: int, seed: int):
        self.length, self.tables, self.parts = length, tables, parts
        self.padded = 1 << max(length - 1, 0).bit_length()
        rng = np.random.default_rng([seed, length])
        self.signs = rng.choice(np.array([-1.0, 1.0]), (tables, parts, ROUNDS, self.padded))

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(x), self.padded))
        y[:, : self.length] = x / np.linalg.norm(x, axis=1, keepdims=True)
        for signs in self.signs[table, part]:
            y = hadamard(y * signs)
        return y

    def _axes(self, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest signed axes of each row, and what they fall short of the nearest."""
        size = np.abs(y)
        at = np.argsort(-size, axis=1, kind="stable")[:, :n]
        near = np.take_along_axis(size, at, 1)
        axis = 2 * at + (np.take_along_axis(y, at, 1) < 0)
        return axis, near[:, :1] - near

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n nearest buckets of each row, nearest first."""
        names, short = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
        for part in range(self.parts):
            axis, more = self._axes(self.turned(x, table, part), min(n, self.padded))
            names = (names[:, :, None] * (2 * self.padded) + axis[:, None, :]).reshape(len(x), -1)
            short = (short[:, :, None] + more[:, None, :] ** 2).reshape(len(x), -1)
            best = np.argsort(short, axis=1, kind="stable")[:, :n]
            names, short = np.take_along_axis(names, best, 1), np.take_along_axis(short, best, 1)
        return names


def parts_for(n_vectors: int, length: int, bucket_rows: float) -> int:
    """How many axes name a bucket so that it holds about ``bucket_rows`` vectors, one at least and at
    most as many as recall was measured for: buckets grow beyond."""
    padded = 1 << max(length - 1, 0).bit_length()
    return min(max(SEARCH), max(1, round(math.log(max(n_vectors, 1) / bucket_rows) / math.log(2 * padded))))


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector of doubles) of the rows that take part."""
    v = F.col("vector")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("id").isNotNull() & v.isNotNull())
        .filter(fit & F.exists(v, lambda x: x != 0))
    )


ROW = "bucket_table int, bucket bigint, length int, id bigint, is_query boolean, vector binary"


def hashed_rows(
    found: DataFrame, is_query: Column, tables: int, parts: int, probes: int, seed: int, dtype: str | None
) -> DataFrame:
    """A row per table of every vector, and a row per table and probe of every query, with the
    vectors as ``dtype``; without ``dtype`` neither vectors nor queries, for counting."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hasher] = {}
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                x = values[offsets[rows][:, None] + np.arange(length)]
                hasher = known.setdefault(int(length), Hasher(int(length), tables, parts, seed))
                payload = np.array([v.tobytes() for v in x.astype(dtype)], dtype=object) if dtype else None
                for table in range(tables):
                    ask = asks[rows]
                    own = hasher.probes(x, table, 1)[:, 0]
                    names = [own]
                    which = [np.arange(len(rows))]
                    kinds = [np.zeros(len(rows), bool)]
                    if dtype and ask.any():
                        q = np.flatnonzero(ask)
                        more = hasher.probes(x[q], table, probes)
                        names.append(more.ravel())
                        which.append(np.repeat(q, more.shape[1]))
                        kinds.append(np.ones(more.size, bool))
                    at = np.concatenate(which)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), table, np.int32)),
                            pa.array(np.concatenate(names)),
                            pa.array(np.full(len(at), length, np.int32)),
                            pa.array(ids[rows][at]),
                            pa.array(np.concatenate(kinds)),
                            pa.array(payload[at], pa.binary()) if dtype else pa.nulls(len(at), pa.binary()),
                        ],
                        names=["bucket_table", "bucket", "length", "id", "is_query", "vector"],
                    )

    return found.select("id", "vector", is_query.alias("is_query")).mapInArrow(over, ROW)


def nearest_in_block(group: pa.Table, k: int, dtype: str, rows_at_once: int = 256) -> pa.Table:
    """The k nearest vectors of the block for each of its queries: (query_id, vec_id, score)."""
    asks = group.column("is_query").to_numpy(zero_copy_only=False)
    ids = group.column("id").to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asks.any() and not asks.all():
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), dtype).reshape(len(ids), -1).astype(float)
        order = np.argsort(ids[~asks], kind="stable")
        vec_ids, vecs = ids[~asks][order], x[~asks][order]
        q_ids, first = np.unique(ids[asks], return_index=True)
        queries = x[asks][first]
        norms = (vecs**2).sum(1)
        for at in range(0, len(q_ids), rows_at_once):
            part = queries[at : at + rows_at_once]
            # Rough distances, up to |q|^2, tell which may be among the nearest; ties stay in.
            rough = norms[None, :] - 2 * part @ vecs.T
            slack = 1e-10 * (norms.max() + (part**2).sum(1))
            for name, q, line, more in zip(q_ids[at : at + rows_at_once], part, rough, slack):
                line[vec_ids == name] = np.inf
                reach = np.partition(line, k - 1)[k - 1] if k < len(line) else np.inf
                some = np.flatnonzero((line <= reach + more) & np.isfinite(line))
                exact = np.sqrt(((vecs[some] - q) ** 2).sum(1))
                best = np.lexsort((vec_ids[some], exact))[:k]
                out.append((np.full(len(best), name), vec_ids[some][best], exact[best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})


FOUND = "query_id bigint, vec_id bigint, score double"


def _in_blocks(rows: DataFrame, by: list[str], sizes: DataFrame, block_rows: int, k: int, dtype: str) -> DataFrame:
    """Search every group of rows, large ones in blocks; ``sizes`` has the groups above a block."""
    blocks = F.coalesce(F.ceil(F.col("m") / block_rows), F.lit(1)).cast("int")
    all_blocks, own = F.sequence(F.lit(0), blocks - 1), F.array(F.pmod(F.xxhash64("id"), blocks).cast("int"))
    placed = rows.join(sizes, by, "left").withColumn("block", F.explode(F.when(F.col("is_query"), all_blocks).otherwise(own)))
    return (
        placed.select(*by, "block", "id", "is_query", "vector")
        .groupBy(*by, "block")
        .applyInArrow(lambda g: nearest_in_block(g, k, dtype), FOUND)
    )


def nearest_neighbours(
    rows: DataFrame,
    is_query: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    tables: int | None = None,
    probes: int | None = None,
    bucket_rows: float = 512,
    block_rows: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for the rows for which
    ``is_query``, a condition on the column ``id``, holds; score is the Euclidean distance.

    ``tables`` and ``probes`` (of a query in each table) are those of ``SEARCH`` unless given: names of
    more axes are finer, so a query has to look into more buckets for the same recall.
    """
    dtype = "<f4" if rows.schema[vector].dataType == T.ArrayType(T.FloatType()) else "<f8"
    found = cut_lineage(usable(rows, id, vector))
    n, length = found.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    parts = parts_for(n, length or 1, bucket_rows)
    tables, probes = tables or SEARCH[parts][0], probes or SEARCH[parts][1]
    by = ["bucket_table", "bucket", "length"]
    codes = hashed_rows(found, F.lit(False), tables, parts, 1, seed, None)
    sizes = cut_lineage(codes.groupBy(*by).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block_rows))
    placed = hashed_rows(found, is_query, tables, parts, probes, seed, dtype)
    near = cut_lineage(_best(_in_blocks(placed, by, sizes, block_rows, k, dtype), k))
    asked = found.filter(is_query).select(F.col("id").alias("query_id")).distinct()
    short = cut_lineage(
        asked.join(near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
        .filter(F.coalesce("n", F.lit(0)) < min(k, max(n - 1, 0)))
        .select(F.col("query_id").alias("id"))
    )
    if short.isEmpty():
        return near
    every = found.select(F.size("vector").alias("length"), "id", F.lit(False).alias("is_query"), "vector")
    again = every.join(short, "id").withColumn("is_query", F.lit(True))
    packed = _as_binary(every.unionByName(again), dtype)
    whole = found.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("m"))
    rest = _best(_in_blocks(packed, ["length"], whole, block_rows, k, dtype), k)
    return near.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)


def _as_binary(rows: DataFrame, dtype: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(dtype)
            data = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(3)] + [pa.array(data, pa.binary())], names=["length", "id", "is_query", "vector"]
            )

    return rows.select("length", "id", "is_query", "vector").mapInArrow(
        over, "length int, id bigint, is_query boolean, vector binary"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    """At most tables x probes x blocks x k rows of a query are ranked together."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
