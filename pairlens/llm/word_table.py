"""BPE encoding and decoding over a table of distinct words.

Documents are split into words, each distinct word is encoded once, and the ids are joined back by
position:

1. A task splits the texts of a block of documents (about ``block_bytes``) into words and writes one
   row: the block's distinct words, the most frequent first, and the documents as numbers of these
   words. The stored table of blocks is what all later steps read.
2. The blocks' words are dealt by their hash over partitions, packed per block. There are so many
   partitions that the words of one fit a worker's memory, so a word is encoded once, however many
   blocks ask for it. The answers go back to their blocks, packed as well.
3. A block and its answers meet; ids are laid out by position. Decoding takes the piece of each id
   from the vocabulary, a table of id and piece bounded by the tokenizer file, and puts one space
   between pieces, as the library does for a file without decoder.

A word is what the tokenizer's own splitting keeps together: a run of letters, a digit, a run of
symbols (see ``tokens``); in texts with other characters, what stands between blanks. A frequent word
is asked for once per block, so no word is hot.

Defined results: a null or empty text has no tokens and decodes to the empty text; null and repeated
ids pass through, repeated rows are documents of their own; a document is never split over blocks,
a longer one is a block alone; other columns are not read. Tables without rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import whole
from pairlens.llm.tokens import Memory, balanced, encoder

BLOCK_BYTES = 16 << 20
WORDS_PER_PARTITION = 400_000
MOST_PARTITIONS = 16_384

BLOCK = "block bigint, doc_ids array<bigint>, n_words array<int>, places binary, n_distinct bigint, words binary, sizes binary"
ASK = "part int, block bigint, places binary, words binary, sizes binary"
ANSWER = "block bigint, places binary, ids binary, sizes binary"


def squeeze(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte planes, without planes of zeros."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    used = max((i + 1 for i in range(4) if planes[i].any()), default=1)
    raw = np.ascontiguousarray(planes[:used]).tobytes()
    head = len(values).to_bytes(8, "little") + bytes([used])
    return head + pa.compress(raw, "zstd", asbytes=True) if raw else head


def expand(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 4), np.uint8)
    if n:
        raw = pa.decompress(data[9:], decompressed_size=n * used, codec="zstd", asbytes=True)
        out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n).T
    return out.view("<u4").ravel()


def pack(values: list[bytes]) -> tuple[bytes, bytes]:
    joined = b"".join(values)
    head = len(joined).to_bytes(8, "little")
    sizes = squeeze(np.fromiter(map(len, values), np.int64, len(values)))
    return head + (pa.compress(joined, "zstd", asbytes=True) if joined else b""), sizes


def unpack(data: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(expand(sizes), dtype=np.int64)
    n = int.from_bytes(data[:8], "little")
    joined = pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""
    return [joined[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())] if len(ends) else []


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [(n.split()[0], kinds[n.split()[1]]) for n in names.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def word_blocks(docs: DataFrame, tokenizer: str, blanks: str, id: str, text: str, block_bytes: int) -> DataFrame:
    """The stored table of blocks."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(tokenizer, blanks).words
        base, nth = TaskContext.get().partitionId() << 32, 0
        doc_ids: list = []
        pieces: list[pa.BinaryArray] = []
        counts: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            coded = pa.concat_arrays(pieces).dictionary_encode()
            index = coded.indices.to_numpy()
            often = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            words, sizes = pack(coded.dictionary.take(pa.array(often)).to_pylist())
            return _rows(BLOCK, [(base + nth, doc_ids, counts, squeeze(place[index]), len(often), words, sizes)])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in balanced(texts, min(block_bytes, 4 << 20)):
                found, per_text = split(texts[a:b])
                doc_ids += ids[a:b]
                pieces.append(found)
                counts += per_text
                size += sum(map(len, texts[a:b]))
                if size >= block_bytes:
                    yield block()
                    doc_ids, pieces, counts, size, nth = [], [], [], 0, nth + 1
        if doc_ids:
            yield block()

    rows = docs.select(F.col(id).cast("long"), whole(F.col(text)))
    return cut_lineage(rows.mapInArrow(over, BLOCK))


def encoded_blocks(blocks: DataFrame, tokenizer: str, blanks: str) -> DataFrame:
    """Answers to all blocks: the ids of their words, every distinct word encoded once."""
    asked = blocks.agg(F.sum("n_distinct")).first()[0] or 0
    parts = min(MOST_PARTITIONS, max(blocks.sparkSession.sparkContext.defaultParallelism, -(-asked // WORDS_PER_PARTITION)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                listed = unpack(words, sizes)
                part = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % parts
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    own = order[bounds[p] : bounds[p + 1]]
                    rows.append((p, block, squeeze(own), *pack([listed[i] for i in own.tolist()])))
                    if len(rows) == 1024:
                        yield _rows(ASK, rows)
                        rows = []
                yield _rows(ASK, rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learn = encoder(tokenizer, blanks).encode_words
        table = Memory(2 * WORDS_PER_PARTITION)
        for batch in batches:
            for block, places, words, sizes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                listed = unpack(words, sizes)
                known = table.hold(listed, learn)
                yield _rows(ANSWER, [(block, places, *pack([known[w] for w in listed]))])

    asks = blocks.select("block", "words", "sizes").mapInArrow(deal, ASK)
    return asks.repartitionById(parts, "part").drop("part").mapInArrow(answer, ANSWER)


@lru_cache(maxsize=4)
def vocabulary(tokenizer: str) -> list[str]:
    """The piece of each id; bounded by the tokenizer file."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    out = [""] * (max(pieces.values()) + 1)
    for piece, number in pieces.items():
        out[number] = piece
    return out


def encode_and_decode(
    docs: DataFrame,
    tokenizer: str,
    result: Callable[[np.ndarray, list[str]], tuple],
    schema: str,
    blanks: str = "dropped",
    id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, *``result``) per document, where ``result`` makes a tuple of the columns of
    ``schema`` out of the document's ids and their pieces."""
    blocks = word_blocks(docs, tokenizer, blanks, id, text, block_bytes)
    answers = encoded_blocks(blocks, tokenizer, blanks)
    columns = f"doc_id bigint, {schema}"

    def join(block: pa.Table, found: pa.Table) -> pa.Table:
        pieces, dtype = vocabulary(tokenizer), encoder(tokenizer, blanks).dtype
        rows = []
        ids_of: list[bytes] = [b""] * block.column("n_distinct")[0].as_py()
        for places, ids, sizes in zip(*(found.column(c).to_pylist() for c in ("places", "ids", "sizes"))):
            for place, value in zip(expand(places).tolist(), unpack(ids, sizes)):
                ids_of[place] = value
        places = expand(block.column("places")[0].as_py())
        ends = np.cumsum(block.column("n_words")[0].as_py(), dtype=np.int64).tolist()
        for doc_id, a, b in zip(block.column("doc_ids")[0].as_py(), [0, *ends[:-1]], ends):
            ids = np.frombuffer(b"".join(map(ids_of.__getitem__, places[a:b].tolist())), dtype)
            rows.append((doc_id, *result(ids, list(map(pieces.__getitem__, ids.tolist())))))
        return pa.Table.from_batches([_rows(columns, rows)])

    kept = blocks.select("block", "doc_ids", "n_words", "places", "n_distinct")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, columns)


def encode(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """(doc_id, ids array, decoded text) of every document."""
    return encode_and_decode(docs, tokenizer, lambda ids, pieces: (ids.tolist(), " ".join(pieces)), "ids array<int>, decoded string", **options)
