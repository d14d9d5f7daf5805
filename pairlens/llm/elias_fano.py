"""Token ids as binary shards with Elias-Fano coded document boundaries.

A shard is one file: a header, the ids of its documents one after the other in the narrowest of
two or four bytes, and two Elias-Fano sequences, the boundaries (n + 1 offsets into the ids) and
the document ids. A sequence of n ascending values below u takes about 2 + log2(u / n) bits per
value: the low bits of each as they are, the high bits as gaps in unary. ``select`` finds the i-th
one among the unary bits from the sampled place of every 256th; no 64-bit offset is stored.

Documents are range partitioned and sorted by id on Spark; each task writes its shards to the shared
folder under names of its own and returns a manifest row for each. Only shards in the manifest,
which Spark commits, count, so a task that runs twice leaves an unread file at worst.

Defined results: a null text is the end id alone; null ids come first and stay null; documents of
equal ids are ordered by a hash of the text; tables without rows give an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage, ensure_checkpoint_dir
from pairlens.llm.common import OWN, open_files, whole
from pairlens.llm.tokens import balanced, encoder

MAGIC = b"EFID0001"
HEADER = struct.Struct("<8sBqqq")  # magic, id width, documents, null ids, ids
SEQUENCE = struct.Struct("<qqBqq")  # values, smallest, low bits, bytes of low part, bytes of high part
SAMPLE = 256
SHARD_IDS = 16_000_000


@dataclass(frozen=True)
class EliasFano:
    """An ascending sequence of integers."""

    n: int
    base: int
    low_bits: int
    low: bytes
    high: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"")
        base = int(values[0])
        v = (values - base).astype(np.uint64)
        low_bits = max(int(v[-1]) // n, 1).bit_length() - 1
        if low_bits:
            places = np.arange(low_bits, dtype=np.uint64)
            bits = ((v[:, None] >> places) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        else:
            low = b""
        tops = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(tops[-1]) + 1, dtype=np.uint8)
        flags[tops] = 1
        return cls(n, base, low_bits, low, np.packbits(flags, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return SEQUENCE.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, base, low_bits, a, b = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        return cls(n, base, low_bits, data[at : at + a], data[at + a : at + a + b]), at + a + b

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, dtype=np.int64)
        start, stop = first * self.low_bits, last * self.low_bits
        raw = np.frombuffer(self.low, np.uint8)[start // 8 : -(-stop // 8)]
        bits = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + stop - start]
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ weights

    def values(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        return ((ones - np.arange(self.n)) << self.low_bits) + self._lows(0, self.n) + self.base


class Select:
    """Random access to an Elias-Fano sequence, from samples of one place in 256."""

    def __init__(self, sequence: EliasFano, sample: int = SAMPLE):
        self.sequence, self.sample = sequence, sample
        self.bytes = np.frombuffer(sequence.high, np.uint8)
        counts = np.bitwise_count(self.bytes).astype(np.int64)
        before = np.cumsum(counts) - counts
        wanted = np.arange(0, sequence.n, sample)
        self.byte = (np.searchsorted(before, wanted, side="right") - 1).astype(np.uint32)
        self.passed = (wanted - before[self.byte]).astype(np.uint8)

    def __call__(self, i: int) -> int:
        s = self.sequence
        if not 0 <= i < s.n:
            raise IndexError(i)
        k = i // self.sample
        at = int(self.byte[k])
        skip = i - k * self.sample + int(self.passed[k])
        while True:
            part = np.flatnonzero(np.unpackbits(self.bytes[at : at + 64], bitorder="little"))
            if skip < len(part):
                place = at * 8 + int(part[skip])
                return ((place - i) << s.low_bits) + int(s._lows(i, i + 1)[0]) + s.base
            skip -= len(part)
            at += 64


@dataclass(frozen=True)
class Shard:
    """The documents of a file."""

    ids: np.ndarray
    bounds: EliasFano
    doc_ids: EliasFano
    n_null: int

    def to_bytes(self) -> bytes:
        head = HEADER.pack(MAGIC, self.ids.itemsize, self.bounds.n - 1, self.n_null, len(self.ids))
        return b"".join([head, self.bounds.to_bytes(), self.doc_ids.to_bytes(), self.ids.tobytes()])

    @classmethod
    def read(cls, data: bytes) -> Shard:
        magic, width, _, n_null, n_ids = HEADER.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        bounds, at = EliasFano.read(data, HEADER.size)
        doc_ids, at = EliasFano.read(data, at)
        return cls(np.frombuffer(data, f"<u{width}", n_ids, at), bounds, doc_ids, n_null)


def build_shard(doc_ids: list[int | None], texts_ids: list[bytes], dtype: np.dtype) -> Shard:
    sizes = np.array([len(x) // dtype.itemsize for x in texts_ids], dtype=np.int64)
    known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    return Shard(
        np.frombuffer(b"".join(texts_ids), dtype),
        EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)),
        EliasFano.of(known),
        len(doc_ids) - len(known),
    )


MANIFEST = "part int, nth int, file string, n_docs bigint, n_ids bigint"


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    blanks: str = "dropped",
    end_id: int = 2,
    id: str = "doc_id",
    text: str = "text",
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write all documents in ascending id order and return the manifest with the offset of each
    shard (``start``). A shard ends with the document that brings it to ``shard_ids`` ids."""
    tie = F.xxhash64(F.col(text)).alias(OWN + "tie")
    ordered = (
        docs.select(F.col(id).cast("long").alias("doc_id"), tie, whole(F.col(text)).alias("text"))
        .repartitionByRange("doc_id", OWN + "tie")
        .sortWithinPartitions("doc_id", OWN + "tie")
        .select("doc_id", "text")
    )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, blanks)
        end = np.array([end_id], enc.dtype).tobytes()
        files, base = open_files(folder)
        part = TaskContext.get().partitionId()
        held: tuple[list, list] = ([], [])
        size = nth = 0

        def flush() -> pa.RecordBatch:
            shard = build_shard(*held, enc.dtype)
            name = f"{base}/ids-{part:06d}-{nth:04d}-{uuid.uuid4().hex}.efid"
            with files.open_output_stream(name) as out:
                out.write(shard.to_bytes())
            row = {"part": part, "nth": nth, "file": name.rsplit("/", 1)[1], "n_docs": len(held[0]), "n_ids": len(shard.ids)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(
                [("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
            ))

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in balanced(texts):
                for number, found in zip(numbers[a:b], enc.encode(texts[a:b])):
                    held[0].append(number)
                    held[1].append(found + end)
                    size += len(found) // enc.dtype.itemsize + 1
                    if size >= shard_ids:
                        yield flush()
                        held, size, nth = ([], []), 0, nth + 1
        if held[0]:
            yield flush()

    files, base = open_files(folder)
    files.create_dir(base, recursive=True)
    manifest = cut_lineage(ordered.mapInArrow(over, MANIFEST))
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard of millions of ids.
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens and ids_crc32."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_files(folder)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_stream(f"{base}/{file}") as source:
                    shard = Shard.read(source.read())
                bounds = shard.bounds.values()
                known = shard.doc_ids.values() if shard.doc_ids.n else np.zeros(0, np.int64)
                numbers = pa.concat_arrays([pa.nulls(shard.n_null, pa.int64()), pa.array(known, pa.int64())])
                crc = [
                    zlib.crc32(shard.ids[a:b].astype("<u4").tobytes())
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [numbers, pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    schema=schema,
                )

    spread = manifest.select("file", "start").repartition("file")
    return spread.mapInArrow(over, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def shard_folder(docs: DataFrame) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(docs.sparkSession)}/token-ids-{uuid.uuid4()}"
