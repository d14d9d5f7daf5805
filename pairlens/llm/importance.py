"""Importance resampling towards a target by hashed n-gram features.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes modulo the number of
buckets. The gain of a bucket compares how often it is met in the target and in the documents, the
weight of a document is the sum of gains over its features, and a document's score adds Gumbel noise
that depends on its id alone. The highest scores are drawn, which draws without replacement with
chances in proportion to exp(weight / 1000).

Buckets come from length-bucketed CRC matrices: the words of a batch of texts, one space between
them, form one array of bytes in which every feature is a slice. The distinct features of a batch are
grouped by their length into two-dimensional arrays of bytes, the CRCs of a whole array advance
column by column, and the buckets are scattered back to all occurrences. (Features of over 2048
bytes are too few for arrays and go through zlib one by one.)

Two passes read the texts: one adds up the buckets, the other the gains. Only the counts of the
buckets, bounded by their number, meet on the driver. The draw ranks narrow rows by range partitions
and counts per partition, without sorting anything in one task.

Defined results: null and blank texts have no features and weight 0; a null id is noise of the empty
id; rows of equal id and score rank in the order of their features; a long text is worked off in
segments that share two words; columns that clash with results are not read. Tables without rows
give no rows, and a target without rows counts as 0 everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import OWN, whole

BUCKETS = 10_000
RUNS = 3
GROUP_BYTES = 4 << 20
LONG_FEATURE = 2048
CELL_ROWS = 1 << 16

IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = bytes(np.flatnonzero(~IN_WORD[LOWER]).tolist())


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte by the reflected polynomial 0xEDB88320."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> 1), crc >> 1)
    return crc


CRC_TABLE = _crc_table()


def crc_of_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data``, by one array of bytes per length."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0, True]) if len(order) else []
    for first, last in zip(bounds[:-1], bounds[1:]):
        length = int(lengths[order[first]])
        if length > LONG_FEATURE:
            for i in order[first:last].tolist():
                out[i] = zlib.crc32(data[starts[i] : starts[i] + length].tobytes())
            continue
        for at in range(first, last, CELL_ROWS):
            rows = order[at : min(at + CELL_ROWS, last)]
            columns = np.empty((length, len(rows)), np.uint8)
            for j in range(length):
                np.take(data, starts[rows] + j, out=columns[j])
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in columns:
                crc = CRC_TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[rows] = ~crc
    return out


def _segments(texts: Iterator[bytes], size: int) -> Iterator[tuple[int, bytes, int]]:
    """(row, part of its text, how many words at its beginning are those of the part before).

    Texts above ``size`` bytes are cut where a word ends.
    """
    for row, text in enumerate(texts):
        if len(text) <= size:
            yield row, text, 0
            continue
        at, carried = 0, b""
        while at < len(text):
            end = min(at + size, len(text))
            while end < len(text) and IN_WORD[LOWER[text[end]]]:
                end += 1
            part = carried + b" " + text[at:end]
            yield row, part, len(carried.split())
            # Only the last two words are needed, whatever separates them.
            tail = part.translate(bytes(np.where(IN_WORD[LOWER], LOWER, 32).astype(np.uint8).tolist()))
            carried, at = b" ".join(tail.rsplit(None, RUNS - 1)[-(RUNS - 1) :]), end


def _groups(texts: list[bytes], size: int = GROUP_BYTES) -> Iterator[list[tuple[int, bytes, int]]]:
    held, group = 0, []
    for part in _segments(iter(texts), size):
        if group and held + len(part[1]) > size:
            yield group
            held, group = 0, []
        group.append(part)
        held += len(part[1])
    if group:
        yield group


def bucket_features(group: list[tuple[int, bytes, int]], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of one, two and three words: the position in ``group`` and the bucket of each feature."""
    data = LOWER[np.frombuffer(b" ".join([g[1] for g in group]) + b" ", np.uint8)]
    inside = IN_WORD[data]
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # one separator behind each word
    ends_of_parts = np.cumsum([len(g[1]) + 1 for g in group])
    opening = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    part = np.searchsorted(ends_of_parts, opening, side="right")
    data, inside = data[kept], inside[kept]
    data[~inside] = 32
    stops = np.flatnonzero(~inside)
    n = len(stops)
    if not n:
        return
    starts = np.r_[0, stops[:-1] + 1]
    words = pa.BinaryArray.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(data)]
    )
    word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    n_words = int(word.max()) + 1
    shared = np.array([g[2] for g in group])[part]
    nth = np.arange(n) - np.searchsorted(part, part)
    code = word
    for k in range(1, RUNS + 1):
        if k > 1:
            code = code[:-1] * n_words + word[k - 1 :]
        code, _ = pd.factorize(code)
        m = len(code)
        if not m:
            return
        first = np.empty(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(m - 1, -1, -1)
        bucket = crc_of_slices(data, starts[first], stops[first + k - 1] - starts[first]) % np.uint32(buckets)
        valid = (part[:m] == part[k - 1 :]) & (nth[:m] + k > shared[:m])
        yield part[:m][valid], bucket[code][valid]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def feature_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that is met."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for group in _groups(_bytes_of(batch.column(0))):
                for _, bucket in bucket_features(group, buckets):
                    counts += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bucket", "n"])

    partial = rows.select(whole(F.col(text))).mapInArrow(over, "bucket int, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths, from the counts of both sides."""
    both = np.zeros((2, buckets))
    # One row per bucket and side.
    for side, bucket, n in documents.select(F.lit(0), "bucket", "n").unionAll(target.select(F.lit(1), "bucket", "n")).collect():
        both[side, bucket] = n
    s, t = both
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""
    buckets = len(gains)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = np.zeros((RUNS, n), np.int64)
            weight = np.zeros(n, np.int64)
            for group in _groups(_bytes_of(batch.column(1))):
                row = np.array([g[0] for g in group])
                for k, (part, bucket) in enumerate(bucket_features(group, buckets)):
                    bounds = np.searchsorted(part, np.arange(len(group) + 1))
                    np.add.at(found[k], row, np.diff(bounds))
                    np.add.at(weight, row, np.diff(np.r_[0, np.cumsum(gains[bucket])][bounds]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found[0]), pa.array(found.sum(axis=0)), pa.array(weight)],
                names=[id, "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col(id).cast("long").alias(id), whole(F.col(text)).alias(OWN + "text"))
    return rows.mapInArrow(over, f"`{id}` bigint, n_words bigint, n_features bigint, weight bigint")


def with_score(weighed: DataFrame, id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Add ``score``: the weight plus noise of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def with_rank(scored: DataFrame, id: str = "doc_id", percent: int = 5, min_words: int = 20) -> DataFrame:
    """Add ``rank``: 1 for the highest score, up to ``percent`` in 100 of the rows with enough words,
    null for all others."""
    enough = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col(id).asc(), F.col("weight"), F.col("n_features")]
    ordered = cut_lineage(
        scored.filter(enough)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(OWN + "at", F.monotonically_increasing_id())
    )
    part = F.shiftright(OWN + "at", 33)
    before = Window.orderBy(OWN + "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    starts = (
        ordered.groupBy(part.alias(OWN + "part"))
        .agg(F.count(F.lit(1)).alias(OWN + "n"))
        .withColumns(
            {
                OWN + "start": F.coalesce(F.sum(OWN + "n").over(before), F.lit(0)),
                OWN + "drawn": F.floor(F.sum(OWN + "n").over(Window.partitionBy()) * percent / 100),
            }
        )
        .drop(OWN + "n")
    )
    rank = F.col(OWN + "start") + F.col(OWN + "at").bitwiseAND((1 << 33) - 1) + 1
    ranked = (
        ordered.withColumn(OWN + "part", part)
        .join(F.broadcast(starts), OWN + "part")
        .withColumn("rank", F.when(rank <= F.col(OWN + "drawn"), rank))
        .select(*scored.columns, "rank")
    )
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    seed: int = 42,
    percent: int = 5,
    min_words: int = 20,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ranked ones are drawn."""
    gains = bucket_gains(feature_counts(docs, text, buckets), feature_counts(target, text, buckets), buckets)
    return with_rank(cut_lineage(with_score(weigh(docs, gains, id, text), id, seed)), id, percent, min_words)
