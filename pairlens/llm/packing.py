"""Hierarchical packing of documents into sequences of several context sizes.

A document is its ids and an end id. Whole windows of the longest context are cut off it; what is
left is routed to the smallest context that holds it. Each context, from the longest down, is packed
from its own documents; the gap that a document leaves in its window is filled with the longest
documents of the shorter contexts that fit, and what still remains with a piece cut off the longest
one left. So every sequence is full to its context size, a power of two, as long as documents last.

A task packs the documents of its partition in pools of bounded size and passes on what does not
fill a window. These ends, less than one window per task, meet in groups of ``fan`` tasks and are
packed again; only the last sequence of such a group may need padding.

Sequences of one context form step groups of equal token counts. Their numbers follow from the
counts per task and context, so no task sees more than its own sequences.

Defined results: a null or empty text is its end id alone; repeated rows and ids are documents of
their own, as pieces carry what they need; null ids stay null; no document is dropped or cut short,
however long; tables without rows give no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import whole
from pairlens.llm.tokens import balanced, encoder

CONTEXTS = (512, 1024, 2048, 4096)
POOL_TOKENS = 4_000_000

PIECE = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("context", pa.int32()),
    ("packer", pa.int64()),
    ("nth", pa.int64()),
    ("ids", pa.binary()),
]
SCHEMA = ", ".join(
    f"{n} {'binary' if t == pa.binary() else 'int' if t == pa.int32() else 'bigint'}" for n, t in PIECE
)


@dataclass(order=True)
class Item:
    """Ids of a document from ``start`` on that are not in a sequence yet."""

    length: int
    number: int
    doc_id: int | None = field(compare=False)
    start: int = field(compare=False)
    total: int = field(compare=False)
    ids: np.ndarray = field(compare=False)


class Packer:
    """Packs items of one task. ``rows`` collects pieces as tuples in the order of PIECE."""

    def __init__(self, packer: int, base: int, contexts: tuple[int, ...] = CONTEXTS):
        self.contexts = tuple(sorted(contexts))
        self.packer, self.base = packer, base
        self.sequences = 0
        self.by_context = dict.fromkeys(self.contexts, 0)
        self.pool: list[Item] = []
        self.held = 0
        self.numbered = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        longest = self.contexts[-1]
        total = len(ids) if total is None else total
        at = 0
        while len(ids) - at >= longest:
            self._emit([(doc_id, start + at, total, ids[at : at + longest])], longest)
            at += longest
        if at < len(ids):
            self.numbered += 1
            rest = ids[at:].copy() if at else ids
            self.pool.append(Item(len(rest), self.numbered, doc_id, start + at, total, rest))
            self.held += len(rest)

    def _emit(self, pieces: list[tuple], context: int) -> None:
        sequence, nth, offset = self.base + self.sequences, self.by_context[context], 0
        for doc_id, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append(
                (doc_id, start, len(ids), crc, total, sequence, offset, context, self.packer, nth, None)
            )
            offset += len(ids)
        self.sequences += 1
        self.by_context[context] += 1

    def pack(self) -> None:
        """Fill sequences until what remains is less than the context at hand."""
        items = sorted(self.pool)
        left = self.held
        for context, below in zip(reversed(self.contexts), [*reversed(self.contexts[:-1]), 0]):
            while left >= context and items and items[-1].length > below:
                pieces, gap = [], context
                while gap:
                    at = bisect_right(items, gap, key=lambda x: x.length) - 1
                    if at >= 0:
                        item = items.pop(at)
                    else:  # all are longer than the gap: cut the longest
                        long = items.pop()
                        item = Item(gap, long.number, long.doc_id, long.start, long.total, long.ids[:gap])
                        rest = long.ids[gap:]
                        insort(items, Item(len(rest), long.number, long.doc_id, long.start + gap, long.total, rest))
                    pieces.append((item.doc_id, item.start, item.total, item.ids))
                    gap -= item.length
                    left -= item.length
                self._emit(pieces, context)
        self.pool, self.held = items, left

    def finish(self) -> None:
        """Put what is left into one last sequence of the longest context."""
        self.pack()
        rest, part, room = self.pool, [], self.contexts[-1]
        for item in rest:
            part.append((item.doc_id, item.start, item.total, item.ids))
            room -= item.length
        if part:
            assert room >= 0
            self._emit(part, self.contexts[-1])
        self.pool, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [[] for _ in PIECE]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=t) for c, (_, t) in zip(columns, PIECE)], names=[n for n, _ in PIECE]
        )

    def leftover(self, width: np.dtype) -> pa.RecordBatch:
        """What is in no sequence yet, as rows that carry their ids."""
        for x in self.pool:
            ids = x.ids.astype(width).tobytes()
            self.rows.append((x.doc_id, x.start, x.length, None, x.total, None, None, None, self.packer, None, ids))
        self.pool, self.held = [], 0
        return self.take()


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    blanks: str = "dropped",
    end_id: int = 2,
    id: str = "doc_id",
    text: str = "text",
    contexts: tuple[int, ...] = CONTEXTS,
    pool_tokens: int = POOL_TOKENS,
    step_tokens: int = 65_536,
    fan: int = 256,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    context and step_group (numbered per context)."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, blanks)
        end = np.array([end_id], dtype=enc.dtype)
        task = TaskContext.get().partitionId()
        packer = Packer(task, task << 32, contexts)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in balanced(texts):
                for doc_id, found in zip(ids[a:b], enc.encode(texts[a:b])):
                    packer.add(doc_id, np.concatenate([np.frombuffer(found, enc.dtype), end]))
                if packer.held > pool_tokens:
                    packer.pack()
                yield packer.take()
        packer.pack()
        yield packer.take()
        yield packer.leftover(np.dtype("<u4"))

    def again(group: pa.Table) -> pa.Table:
        group = group.sort_by([("packer", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        number = group.column("packer")[0].as_py() // fan
        packer = Packer((1 << 40) + number, (1 << 62) + (number << 32), contexts)
        for doc_id, start, total, ids in zip(
            *(group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        ):
            packer.add(doc_id, np.frombuffer(ids, "<u4"), start, total)
        packer.finish()
        return pa.Table.from_batches([packer.take()])

    texts = docs.select(F.col(id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text"))
    packed = cut_lineage(texts.mapInArrow(first, SCHEMA))
    ends = packed.filter(F.col("sequence_id").isNull())
    grouped = ends.withColumn("_group", F.floor(F.col("packer") / fan)).groupBy("_group").applyInArrow(again, SCHEMA)
    pieces = packed.filter(F.col("sequence_id").isNotNull()).unionByName(cut_lineage(grouped)).drop("ids")
    return with_step_groups(pieces, step_tokens)


def with_step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Number the sequences of each context through all tasks and put as many together as make
    ``step_tokens``."""
    before = Window.partitionBy("context").orderBy("packer").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(
        pieces.filter("offset = 0")
        .groupBy("context", "packer")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    per_step = F.greatest(F.floor(F.lit(step_tokens) / F.col("context")), F.lit(1))
    return (
        pieces.join(bases, ["context", "packer"])
        .withColumn("step_group", F.floor((F.col("_before") + F.col("nth")) / per_step))
        .drop("packer", "nth", "_before")
    )
