"""Katz backoff over words: Good-Turing discounted n-gram counts of every order up to a given one, with
backoff weights that normalise exactly.

Text is lower-cased (A-Z) and cut into words; an end token closes a document and is the context of
its first word. With h the words before w, h' these without the first, and c the counts,

    p(w | h) = d(c(h w)) c(h w) / c(h)   if the n-gram was seen,
               a(h) p(w | h')            if only the context was,
               p(w | h')                 otherwise;
    p(w)     = d(c(w)) c(w) / N          for known words, and what is left for an unknown one.

Near its beginning a document has shorter contexts: its first word follows the end token alone, the
second the end token and the first, and so on. d is the Good-Turing discount of its order for counts up
to ``TOP`` (1 above). a(h) is the mass the discounts set free after h over the mass that p(. | h') gives
to words not seen after h. A context all of whose counts are undiscounted frees 1 of c(h) + 1 parts
instead. All words seen after h were seen after h' too, so the mass of these is a sum of d(c(h' w))
c(h' w), and the counts of lower n-grams are all that a partition needs to know about the order below.

How it runs. Documents become blocks of a million tokens or two: files of numbers into the block's own
list of word hashes. Order by order, blocks ask partitions of the n-grams, by context, for counts; the
answers carry ids of the n-grams, which name the contexts of the next order, and for contexts from
which the block backs off the numbers of successors by count and by lower count. Then each block
evaluates its n-grams order by order, each from its lower one, and adds up its tokens. Questions are packed
arrays, one per block and partition, never a row per token, and the partitions hold the whole count
tables. Contexts of more than ``hot`` tokens are spread over several partitions by their successor,
and the block adds the answers up. What returns to the driver is a vector of counts of counts per order.

``fit`` keeps the count tables, a row per order and partition of contexts, and ``score_by`` scores any
texts from them. ``score_documents`` learns and scores in one go over the same questions and keeps none.

Defined results: a null or empty text is its end token alone; rows without id are trained on as
``training`` says of a null id (false if it is null); repeated rows count as often as they occur;
without training rows every token is unknown with probability 1. Tables without rows give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage, ensure_checkpoint_dir
from pairlens.llm.common import open_files, whole

END = np.uint64(0x5E9D3C7F00000001)
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK_TOKENS = 1_500_000
PART_ENTRIES = 2_000_000
TOP = 5
ORDER = 3
FORMAT = 2  #: of saved models; in the first, words had ids by hash


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; bytes of equal weight stand together, as they are alike."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    data = head + b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    kinds = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 * (2 * n + 1), []
    for char, length in kinds.tolist():
        kind = np.dtype(chr(char))
        planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        at += length * kind.itemsize
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending integers from 0 on; ``np.cumsum`` undoes it."""
    return narrow(np.diff(ascending, prepend=0))


def steps_in_runs(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Differences within runs of ascending integers, each run from 0 on."""
    out = np.diff(values, prepend=0)
    first = (np.cumsum(runs) - runs)[runs > 0]
    out[first] = values[first]
    return narrow(out)


def from_steps_in_runs(differences: np.ndarray, runs: np.ndarray) -> np.ndarray:
    total = np.cumsum(differences.astype(np.int64))
    first = np.cumsum(runs) - runs
    before = np.r_[0, total][first]
    return total - np.repeat(before, runs)


def narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def ascending(values: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers; value and position are sorted as one number if they fit one."""
    bits = len(values).bit_length()
    if not len(values) or int(values.max()).bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    return np.sort(values.astype(np.int64) << bits | np.arange(len(values))) & ((1 << bits) - 1)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct non-negative integers in ascending order, and the position of each value among them."""
    order = ascending(values)
    ordered = values[order]
    new = changes(ordered)
    where = np.empty(len(values), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return ordered[new], where


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX
    h ^= h >> np.uint64(31)
    h = h * STEP
    return h ^ (h >> np.uint64(29))


def discounts(counts_of_counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """Good-Turing discount factors of counts 0 to top (that of 0 is unused), 1 where the counts of
    counts do not support one. ``counts_of_counts[r]`` is the number of types seen r times."""
    n = counts_of_counts.astype(float)
    for k in range(top, 0, -1):
        if n[1] <= 0 or (n[1 : k + 2] <= 0).any():
            continue
        r = np.arange(1, k + 1)
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d, np.ones(top - k)])
    return np.ones(top + 1)


class Unigrams:
    """p(w) by training count."""

    def __init__(self, counts_of_counts: np.ndarray, tokens: int, types: int):
        self.tokens, self.types = tokens, types
        self.d = discounts(counts_of_counts)
        r = np.arange(1, TOP + 1)
        freed = float(((1 - self.d[1:]) * r * counts_of_counts[1 : TOP + 1]).sum())
        self.total = tokens if freed > 0 else tokens + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        factor = np.where(counts <= TOP, self.d[np.minimum(counts, TOP)], 1.0)
        return np.where(counts > 0, factor * counts / self.total, self.unknown)


@dataclass(frozen=True)
class Layout:
    """The order of a model and how its tables are partitioned."""

    order: int
    word_parts: int
    parts: int
    hot: int


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words (A-Z only, ASCII blanks) of all texts in a row, and their number in each text."""
    blank_free = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(blank_free)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[pc.binary_length(blank_free).to_numpy(zero_copy_only=False) == 0] = 0
    return words.filter(pc.not_equal(pc.binary_length(words), 0)), counts


INDEX = "block bigint, file string, n_words bigint, n_tokens bigint"
INDEX_ARROW = pa.schema([("block", pa.int64()), ("file", pa.string()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def blocks_of(docs: DataFrame, training: Column, id: str, text: str, block_tokens: int) -> DataFrame:
    """Write the blocks to the shared folder; a row per block with its file."""
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/katz-{uuid.uuid4()}"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_files(folder)
        first, nth = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        trained: list[bool] = []
        counted: list[np.ndarray] = []
        coded: list[np.ndarray] = []  # words as numbers of their distinct hashes, batch by batch
        distinct: list[np.ndarray] = [np.array([END])]
        size, n_distinct = 0, 1

        def flush() -> pa.RecordBatch:
            lengths = np.concatenate(counted) + 1
            hashes, which = np.unique(np.concatenate(distinct), return_inverse=True)
            is_word = np.ones(size, dtype=bool)
            is_word[np.cumsum(lengths) - 1] = False
            tokens = np.full(size, which[0])
            tokens[is_word] = which[np.concatenate(coded)]
            counts = np.bincount(tokens, minlength=len(hashes))
            frequent = np.argsort(-counts, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(hashes), dtype=np.uint32)
            rank[frequent] = np.arange(len(hashes), dtype=np.uint32)
            known = np.array([i is not None for i in ids])
            numbers = np.array([i or 0 for i in ids], dtype=np.int64)
            # A task that runs again writes files of its own; only those in the table count.
            name = f"block-{first + nth}-{uuid.uuid4().hex}"
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(numbers, known, np.array(trained), narrow(lengths), rank[tokens], hashes[frequent]))
            row = {"block": first + nth, "file": f"{folder}/{name}", "n_words": len(hashes), "n_tokens": len(tokens)}
            return pa.RecordBatch.from_pylist([row], schema=INDEX_ARROW)

        for batch in batches:
            texts = batch.column(2)
            words, counts = words_of(texts)
            numbers, uses = (batch.column(i).to_pylist() for i in range(2))
            ends = np.r_[0, np.cumsum(counts)]
            done = 0
            while done < len(texts):
                upto = np.searchsorted(ends + np.arange(len(ends)), ends[done] + done + block_tokens - size)
                upto = min(int(upto), len(texts))
                ids += numbers[done:upto]
                trained += uses[done:upto]
                counted.append(counts[done:upto])
                own = words[ends[done] : ends[upto]].dictionary_encode()
                coded.append(own.indices.to_numpy() + n_distinct)
                seen = own.dictionary.cast(pa.binary()).to_pylist()
                distinct.append(np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen)))
                n_distinct += len(seen)
                size += int(ends[upto] - ends[done]) + upto - done
                done = upto
                if size >= block_tokens:
                    yield flush()
                    ids, trained, counted, coded, distinct = [], [], [], [], distinct[:1]
                    size, n_distinct, nth = 0, 1, nth + 1
        if ids:
            yield flush()

    files, base = open_files(folder)
    files.create_dir(base, recursive=True)
    use = F.coalesce(training, F.lit(False))
    return cut_lineage(docs.select(F.col(id).cast("long"), use, whole(F.col(text).cast("string"))).mapInArrow(over, INDEX))


@dataclass
class Level:
    """The distinct n-grams of one order in a block, by ascending id. Unseen ones have the id -1."""

    token: np.ndarray  #: the n-gram that ends at each token, -1 where none with a seen context does
    counts: np.ndarray
    ids: np.ndarray
    context: np.ndarray | None = None  #: n-gram of the order below that ends one token before
    word: np.ndarray | None = None
    lower: np.ndarray | None = None  #: n-gram of the order below that ends at the same token
    open: np.ndarray | None = None  #: for n-grams of the order below: may the block back off from it?

    def by_id(self) -> Level:
        order = ascending(self.ids + 1)
        rank = np.empty(len(order) + 1, dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        rank[-1] = -1
        moved = [x if x is None else x[order] for x in (self.context, self.word, self.lower)]
        return Level(rank[self.token], self.counts[order], self.ids[order], *moved, self.open)


@dataclass
class Masses:
    """What is known of the contexts of an order after its answers."""

    freed: np.ndarray
    covered: np.ndarray
    least: np.ndarray


class Block:
    """A block read back."""

    def __init__(self, number: int, file: str):
        self.number = number
        files, name = open_files(file)
        with files.open_input_stream(name) as source:
            numbers, known, self.training, lengths, words, self.hashes = unpack(source.read())
        self.doc_ids = pa.array(numbers, pa.int64(), mask=~known)
        self.lengths = lengths.astype(np.int64)
        self.words = words.astype(np.int32)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.token_training = np.repeat(self.training, self.lengths)

    def word_level(self, answers: dict[tuple[int, int], bytes], layout: Layout) -> Level:
        n = len(self.hashes)
        counts, ids = np.zeros(n, dtype=np.int64), np.full(n, -1)
        for p, at in _split(word_part(self.hashes, layout.word_parts)):
            count, rank = unpack(answers[1, p])
            counts[at] = count
            ids[at] = np.where(count > 0, rank.astype(np.int64) * layout.word_parts + p, -1)
        return Level(self.words, counts, ids).by_id()

    def level(self, below: Level, words: Level) -> Level:
        """The n-grams of the next order whose contexts were seen; counts and ids are still to come."""
        before = np.empty(len(self.words), dtype=np.int64)
        before[1:] = below.token[:-1]
        before[self.first] = words.token[-1] if below is words else -1  # the last token is an end
        seen = np.append(below.counts > 0, False)
        valid = np.flatnonzero(seen[before])
        n = len(words.counts)
        pairs, where = grouped(before[valid] * n + words.token[valid])
        token = np.full(len(self.words), -1, dtype=np.int32)
        token[valid] = where
        lower = np.empty(len(pairs), dtype=np.int64)
        lower[where] = below.token[valid]
        context, word = np.divmod(pairs, n)
        counts = np.bincount(where[self.token_training[valid]], minlength=len(pairs))  # in this block
        is_open = np.bincount(context, counts == 0, len(below.counts)) > 0
        return Level(token, counts, np.full(len(pairs), -1), context, word, lower, is_open)

    def levels(
        self, answers: dict[tuple[int, int], bytes], upto: int, layout: Layout, d: list[np.ndarray]
    ) -> tuple[list[Level], list[Masses]]:
        """Answered levels 1 to ``upto``, and the masses after the contexts of levels 2 to ``upto``."""
        found, masses = [self.word_level(answers, layout)], []
        for k in range(2, upto + 1):
            below, level = found[-1], self.level(found[-1], found[0])
            n = len(below.counts)
            after = Masses(np.zeros(n), np.zeros(n), np.full(n, TOP + 1, dtype=np.uint8))
            counts = np.zeros(len(level.counts), dtype=np.int64)
            factor, lower_factor = (x[1:] * np.arange(1, TOP + 1) for x in (1 - d[k - 1], d[k - 2]))
            for p, at, contexts in routes(level, below, found[0], layout):
                count, rank, least, *sums = unpack(answers[k, p])
                counts[at] = count
                if k < layout.order:
                    level.ids[at] = np.where(count > 0, np.cumsum(rank.astype(np.int64)) * layout.parts + p, -1)
                after.least[contexts] = np.minimum(after.least[contexts], least)
                wide = contexts[level.open[contexts]]
                for r in range(TOP):
                    after.freed[wide] += factor[r] * sums[r]
                    after.covered[wide] += lower_factor[r] * sums[TOP + r]
                after.covered[wide] += sums[-1]
            level.counts = counts
            found.append(level.by_id() if k < layout.order else level)
            masses.append(after)
        return found, masses


ASK = "part bigint, block bigint, question binary"
ASK_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("question", pa.binary())])
ANSWER = "kind int, level int, block bigint, part bigint, answer binary"
ANSWER_ARROW = pa.schema(
    [("kind", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("answer", pa.binary())]
)
REPLY, STATS, TABLE, META = range(4)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, positions in ascending order) of each partition in ``part``."""
    order = ascending(part)
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(part[at[0]]), at


def word_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(parts)).astype(np.int64)


def routes(level: Level, below: Level, words: Level, layout: Layout) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, its n-grams, its contexts) of the block, in ascending order each.

    An n-gram goes by its context, and if that is hot by its word too. One whose lower n-gram is unseen is
    unseen itself and is not asked for. The block asks every partition of a hot context about it,
    those where it has no n-gram of its own included.
    """
    asked = np.flatnonzero(below.counts[level.lower] > 0)
    context = level.context[asked]
    spread = np.maximum(-(-below.counts // layout.hot), 1)
    ids = below.ids.astype(np.uint64)

    def part(contexts: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mixed(ids[contexts] * STEP + salt.astype(np.uint64)) % np.uint64(layout.parts)).astype(np.int64)

    salt = mixed(words.ids[level.word[asked]].astype(np.uint64)) % spread[context].astype(np.uint64)
    of_gram = dict(_split(part(context, salt)))
    present = level.context[changes(level.context)]
    times = spread[present]
    every = np.repeat(present, times)
    salts = np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
    none = np.zeros(0, dtype=np.int64)
    for p, at in _split(part(every, salts)):
        yield p, asked[of_gram.get(p, none)], every[at][changes(every[at])]


def find(values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Positions in ascending ``values``, -1 for what is not there."""
    if not len(values):
        return np.full(len(sought), -1)
    at = np.minimum(np.searchsorted(values, sought), len(values) - 1)
    return np.where(values[at] == sought, at, -1)


class WordTable:
    """The seen words of a partition by ascending hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.ranks = np.empty(len(counts), dtype=np.int64)  # frequent words get small ids, which take less room
        self.ranks[np.argsort(-counts, kind="stable")] = np.arange(len(counts))

    @classmethod
    def of(cls, questions: list[bytes]) -> WordTable:
        asked = [unpack(q) for q in questions]
        hashes, where = np.unique(np.concatenate([q[0] for q in asked]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([q[1].astype(np.int64) for q in asked]), len(hashes)).astype(np.int64)
        return cls(hashes[counts > 0], counts[counts > 0])

    @classmethod
    def read(cls, data: bytes | None) -> WordTable:
        if data is None:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hashes, counts = unpack(data)
        return cls(hashes, counts.astype(np.int64))

    def to_bytes(self) -> bytes:
        return pack(self.hashes, narrow(self.counts))

    def answer(self, question: bytes, last: bool) -> bytes:
        at = find(self.hashes, unpack(question)[0])
        return pack(narrow(np.append(self.counts, 0)[at]), narrow(np.append(self.ranks, 0)[at]))

    def stats(self) -> np.ndarray:
        return np.concatenate([_counts_of_counts(self.counts), [self.counts.sum(), len(self.counts)]])


class GramTable:
    """The seen n-grams of a partition, by ascending ids of context and word, with their counts and those
    of their lower n-grams."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: np.ndarray):
        self.contexts, self.words, self.keys, self.counts, self.low = contexts, words, keys, counts, low
        own, n = keys // max(len(words), 1), len(contexts) + 1  # the last one stands for contexts not here
        self.least = np.full(n, TOP + 1, dtype=np.uint8)
        self.sums = []
        for r in range(TOP, 0, -1):
            self.least[own[counts == r]] = r
        for of in (counts, low):
            self.sums += [narrow(np.bincount(own[of == r], minlength=n)) for r in range(1, TOP + 1)]
        large = low > TOP
        self.sums.append(np.bincount(own[large], low[large], n).astype(np.int64))

    @classmethod
    def of(cls, questions: list[bytes]) -> GramTable:
        asked = [_read_question(q) for q in questions]
        contexts, which = grouped(np.concatenate([q[0] for q in asked]))
        words, follows = grouped(np.concatenate([q[3] for q in asked]))
        keys, at, done = [], 0, 0
        for ids, runs, _, followers, number, _, _ in asked:
            own, word = which[at : at + len(ids)], follows[done : done + len(followers)]
            at, done = at + len(ids), done + len(followers)
            keys.append(np.repeat(own, runs) * len(words) + word[number])
        del which, follows
        keys, where = grouped(np.concatenate(keys))
        counts = np.bincount(where, np.concatenate([q[5] for q in asked]), len(keys)).astype(np.int64)
        low = np.zeros(len(keys), dtype=np.int64)
        low[where] = np.concatenate([q[6] for q in asked])
        real = counts > 0
        return cls(contexts, words, keys[real], counts[real], low[real])

    @classmethod
    def read(cls, data: bytes | None) -> GramTable:
        if data is None:
            return cls(*[np.zeros(0, np.int64)] * 5)
        contexts, runs, words, word, counts, low = (x.astype(np.int64) for x in unpack(data))
        words = np.cumsum(words)
        keys = np.repeat(np.arange(len(runs)), runs) * len(words) + from_steps_in_runs(word, runs)
        return cls(np.cumsum(contexts), words, keys, counts, low)

    def to_bytes(self) -> bytes:
        own, word = np.divmod(self.keys, max(len(self.words), 1))
        runs = np.bincount(own, minlength=len(self.contexts))
        return pack(
            steps(self.contexts), narrow(runs), steps(self.words), steps_in_runs(word, runs),
            narrow(self.counts), narrow(self.low),
        )

    def answer(self, question: bytes, last: bool) -> bytes:
        """Counts and ranks of n-grams (the last order needs none), the least count after each context, and
        sums of open contexts."""
        ids, runs, is_open, followers, number, _, _ = _read_question(question)
        own, word = find(self.contexts, ids), find(self.words, followers)[number]
        context = np.repeat(own, runs)
        key = np.where((context >= 0) & (word >= 0), context * len(self.words) + word, -1)
        at = find(self.keys, key)
        rank = at[:0] if last or not len(at) else np.maximum.accumulate(np.maximum(at, 0))
        return pack(
            narrow(np.append(self.counts, 0)[at]), steps(rank), self.least[own],
            *[narrow(s[own[is_open]]) for s in self.sums],
        )

    def stats(self) -> np.ndarray:
        return np.concatenate([_counts_of_counts(self.counts), [0, 0]])


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(counts[counts <= TOP + 1], minlength=TOP + 2)[: TOP + 2]


def ask_words(index: DataFrame, layout: Layout) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["block"], row["file"])
                counts = np.bincount(b.words[b.token_training], minlength=len(b.hashes))
                rows = [
                    {"part": p, "block": b.number, "question": pack(b.hashes[at], narrow(counts[at]))}
                    for p, at in _split(word_part(b.hashes, layout.word_parts))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=ASK_ARROW)

    return index.mapInArrow(over, ASK)


def _opened(left: pa.Table, right: pa.Table) -> tuple[Block, dict[tuple[int, int], bytes]]:
    answers = zip(*(right.column(c).to_pylist() for c in ("level", "part", "answer")))
    row = left.to_pylist()[0]
    return Block(row["block"], row["file"]), {(k, p): data for k, p, data in answers}


def ask_grams(left: pa.Table, right: pa.Table, k: int, layout: Layout, d: list[np.ndarray]) -> pa.Table:
    block, answers = _opened(left, right)
    found, _ = block.levels(answers, k - 1, layout, d)
    below, words = found[-1], found[0]
    level = block.level(below, words)
    rows = []
    for p, at, contexts in routes(level, below, words, layout):
        runs = np.bincount(np.searchsorted(contexts, level.context[at]), minlength=len(contexts))
        followers, number = grouped(level.word[at])
        question = pack(
            steps(below.ids[contexts]), narrow(runs), level.open[contexts], steps(words.ids[followers]),
            steps_in_runs(number, runs), narrow(level.counts[at]), narrow(below.counts[level.lower[at]]),
        )
        rows.append({"part": p, "block": block.number, "question": question})
    return pa.Table.from_pylist(rows, schema=ASK_ARROW)


def _read_question(question: bytes) -> tuple[np.ndarray, ...]:
    contexts, runs, is_open, followers, number, seen, low = unpack(question)
    runs = runs.astype(np.int64)
    number = from_steps_in_runs(number, runs)
    return np.cumsum(contexts.astype(np.int64)), runs, is_open, np.cumsum(followers.astype(np.int64)), number, seen, low


def answer_part(group: pa.Table, k: int, keep: bool, last: bool, stored: pa.Table | None = None) -> pa.Table:
    """Answer the questions to a partition of order ``k``, from a stored table or from their own counts."""
    if not group.num_rows:
        return pa.Table.from_pylist([], schema=ANSWER_ARROW)
    part = group.column("part")[0].as_py()
    questions = group.column("question").to_pylist()
    kind = WordTable if k == 1 else GramTable
    if stored is None:
        table = kind.of(questions)
    else:
        table = kind.read(stored.column("answer")[0].as_py() if stored.num_rows else None)
    rows = [
        {"kind": REPLY, "level": k, "block": block, "part": part, "answer": table.answer(q, last)}
        for block, q in zip(group.column("block").to_pylist(), questions)
    ]
    if stored is None:
        stats = table.stats().astype(np.int64).tobytes()
        rows.append({"kind": STATS, "level": k, "block": None, "part": part, "answer": stats})
    if keep:
        rows.append({"kind": TABLE, "level": k, "block": None, "part": part, "answer": table.to_bytes()})
    return pa.Table.from_pylist(rows, schema=ANSWER_ARROW)


SCORE = "doc_id bigint, training boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def evaluate(left: pa.Table, right: pa.Table, layout: Layout, unigrams: Unigrams, d: list[np.ndarray]) -> pa.Table:
    block, answers = _opened(left, right)
    found, masses = block.levels(answers, layout.order, layout, d)
    words = found[0]
    p = unigrams.p(words.counts)
    log_p = np.log10(p)[words.token]
    total_below: np.ndarray | None = None
    for k in range(2, layout.order + 1):
        below, level, after, factors = found[k - 2], found[k - 1], masses[k - 2], d[k - 1]
        # A context frees something if its rarest successor is discounted.
        frees = np.append(factors[1:] < 1, False)[after.least - 1]
        total = np.where(frees, below.counts, below.counts + 1.0)
        tail = unigrams.total if total_below is None else total_below[below.lower]
        rest = np.maximum(1 - after.covered / tail, 1e-300)
        backoff = np.where(frees, after.freed, 1.0) / np.maximum(total, 1) / rest
        count = level.counts
        seen = np.where(count <= TOP, factors[np.minimum(count, TOP)], 1.0) * count / total[level.context]
        p = np.where(count > 0, seen, backoff[level.context] * p[level.lower])
        at = np.flatnonzero(level.token >= 0)
        log_p[at] = np.log10(p)[level.token[at]]
        total_below = total
    base = np.log10((words.counts + 0.5) / (unigrams.tokens + 0.5 * (unigrams.types + 1)))

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, block.first)  # no document is without its end token

    return pa.table(
        {
            "doc_id": block.doc_ids,
            "training": pa.array(block.training),
            "n_tokens": pa.array(block.lengths),
            "n_known": pa.array(per_doc((words.counts > 0).astype(np.int64)[words.token])),
            "base_score": pa.array(per_doc(base[words.token])),
            "score": pa.array(per_doc(log_p)),
        }
    )


def _stats(answers: DataFrame) -> list[int]:
    """Sum of the statistics of all partitions; each is a vector of a few numbers."""
    rows = answers.filter(F.col("kind") == STATS).select("answer")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                v = np.frombuffer(data, np.int64)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["v"])

    vectors = rows.mapInArrow(add, "v array<bigint>")
    summed = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = [0] * (TOP + 4)
    for i, x in summed:
        out[i] = x
    return out


@dataclass(frozen=True)
class Model:
    """Kept count tables, ``level`` and ``part`` to a packed table, and what the driver knows of them."""

    tables: DataFrame
    layout: Layout
    stats: list[list[int]]

    def save(self, path: str) -> None:
        meta = json.dumps({"format": FORMAT, "layout": asdict(self.layout), "stats": self.stats}).encode()
        spark = self.tables.sparkSession
        about = spark.createDataFrame([(META, 0, None, 0, bytearray(meta))], ANSWER)
        self.tables.unionByName(about).write.partitionBy("level").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path)
        meta = json.loads(bytes(rows.filter("level = 0").first()["answer"]))
        if meta.get("format") != FORMAT:
            raise ValueError(f"{path} holds a model of another format; fit it again")
        return cls(rows.filter("level > 0"), Layout(**meta["layout"]), meta["stats"])


def _unigrams(stats: list[int]) -> Unigrams:
    return Unigrams(np.array(stats[: TOP + 2]), stats[TOP + 2], stats[TOP + 3])


def _answered(
    index: DataFrame, n_blocks: int, layout: Layout, keep: bool = False, model: Model | None = None
) -> tuple[list[DataFrame], list[list[int]], list[np.ndarray]]:
    """Tables of answers, statistics and discounts, order by order."""
    tables: list[DataFrame] = []
    stats: list[list[int]] = []
    d: list[np.ndarray] = []
    for k in range(1, layout.order + 1):
        if k == 1:
            questions = ask_words(index.repartition(max(1, n_blocks)), layout)
        else:
            questions = _per_block(index, tables, n_blocks, _asker(k, layout, list(d)), ASK)
        parts = layout.word_parts if k == 1 else layout.parts
        asked = questions.repartition(parts, "part").groupBy("part")
        if model is None:
            answers = asked.applyInArrow(_counter(k, keep, k == layout.order), ANSWER)
        else:
            stored = model.tables.filter(F.col("level") == k).select("part", "answer").repartition(parts, "part")
            answers = asked.cogroup(stored.groupBy("part")).applyInArrow(_reader(k, k == layout.order), ANSWER)
        tables.append(cut_lineage(answers))
        stats.append(_stats(tables[-1]) if model is None else model.stats[k - 1])
        d.append(discounts(np.array(stats[-1][: TOP + 2])))
    return tables, stats, d


def _asker(k: int, layout: Layout, d: list[np.ndarray]):
    return lambda left, right: ask_grams(left, right, k, layout, d)


def _counter(k: int, keep: bool, last: bool):
    return lambda group: answer_part(group, k, keep, last)


def _reader(k: int, last: bool):
    return lambda group, stored: answer_part(group, k, False, last, stored)


def _per_block(index: DataFrame, tables: list[DataFrame], n_blocks: int, apply, schema: str) -> DataFrame:
    """``apply`` each block's row and the answers to it; a task per block, and no block is shuffled."""
    answers = tables[0]
    for t in tables[1:]:
        answers = answers.unionByName(t)
    answers = answers.filter(F.col("kind") == REPLY).select("level", "block", "part", "answer")
    left, right = (x.repartition(max(1, n_blocks), "block").groupBy("block") for x in (index, answers))
    return left.cogroup(right).applyInArrow(apply, schema)


def _evaluated(
    index: DataFrame, tables: list[DataFrame], n_blocks: int, layout: Layout, stats: list[list[int]], d: list[np.ndarray]
) -> DataFrame:
    unigrams = _unigrams(stats[0])
    scored = _per_block(
        index, tables, n_blocks, lambda left, right: evaluate(left, right, layout, unigrams, d), SCORE
    )
    return scored.withColumn("train_tokens", F.lit(unigrams.tokens).cast("long"))


def _laid_out(index: DataFrame, order: int, part_entries: int, hot: int) -> tuple[int, Layout]:
    n_blocks, n_words, n_tokens = index.agg(F.count("*"), F.sum("n_words"), F.sum("n_tokens")).first()
    word_parts, parts = (max(1, -(-(n or 0) // part_entries)) for n in (n_words, n_tokens))
    return n_blocks, Layout(order, word_parts, parts, hot)


def fit(
    docs: DataFrame,
    order: int = ORDER,
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    part_entries: int = PART_ENTRIES,
    hot: int = 1_000_000,
) -> Model:
    """Count the n-grams of all rows of ``docs`` and keep the tables."""
    numbered = docs.select(F.lit(None).cast("long").alias("doc_id"), text)
    index = blocks_of(numbered, F.lit(True), "doc_id", text, block_tokens)
    n_blocks, layout = _laid_out(index, order, part_entries, hot)
    answers, stats, _ = _answered(index, n_blocks, layout, keep=True)
    tables = answers[0]
    for t in answers[1:]:
        tables = tables.unionByName(t)
    return Model(tables.filter(F.col("kind") == TABLE), layout, stats)


def score_by(
    model: Model, docs: DataFrame, id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Score every row of ``docs`` from the kept tables of a model; columns as of ``score_documents``."""
    index = blocks_of(docs, F.lit(False), id, text, block_tokens)
    n_blocks = index.count()
    answers, stats, d = _answered(index, n_blocks, model.layout, model=model)
    return _evaluated(index, answers, n_blocks, model.layout, stats, d)


def score_documents(
    docs: DataFrame,
    training: Column,
    order: int = ORDER,
    id: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    part_entries: int = PART_ENTRIES,
    hot: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, training, n_tokens, n_known, train_tokens, base_score
    and score (log10 probabilities), by a model of the rows for which ``training`` holds."""
    index = blocks_of(docs, training, id, text, block_tokens)
    n_blocks, layout = _laid_out(index, order, part_entries, hot)
    answers, stats, d = _answered(index, n_blocks, layout)
    return _evaluated(index, answers, n_blocks, layout, stats, d)
