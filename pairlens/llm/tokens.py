"""Exact token ids of long texts at the speed of their distinct pieces.

The tokenizers library splits a text into pieces before it merges characters: runs of letters, digits
or symbols. Pieces repeat, so a worker keeps the ids of those it met and hands only new ones to the
library, many at a time. Its memory has two generations of bounded size: when the young one is full
it becomes the old one, from which what is met again is taken back.

Texts of plain characters (printable ASCII, blanks, and Latin letters below U+0240 that lower to one
letter and combine with nothing) are cut into pieces in numpy, a batch at a time, and only the distinct
pieces of a batch are looked up. A run ends where the kind of its characters changes, save behind an
apostrophe that stands alone before letters, as in "it's": what follows goes to the library with it.
All other texts are cut before the blanks behind a word (a safe boundary), and their chunks encoded.

Two kinds of tokenizers are told apart by what they do with blanks:

* ``dropped``: blanks only separate, digits are pieces of their own, and letters are lowered.
* ``kept``: a space belongs to the piece behind it, digits form runs, other blanks are pieces. Where
  another Unicode blank touches a chunk's edge the cut would not be safe, so texts with such
  characters are encoded as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANKS_KEPT_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
OTHER_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CUT = re.compile(r"(?<=[^ \t-\r])(?=[ \t-\r])")
NOT_PLAIN = re.compile("[^ \t-\r!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u023f]|<\\|")
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u023f"
ONE_RUN = re.compile(f"[{LETTERS}]+|[0-9]|[!-&(-/:-@\\[-`{{-~]+")
PLAIN_BYTES = bytes([*range(9, 14), 32, *range(33, 127), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
OTHER_BYTES = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"<|")
SEGMENT_CHARS = 1 << 20
JOINED = 256
BLANK, LETTER, DIGIT, SYMBOL = range(4)
SPACE, APOSTROPHE = 32, 39

KIND = np.full(256, LETTER, np.uint8)  # bytes above 127 are parts of letters in plain texts
KIND[:128] = SYMBOL
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def all_plain(texts: list[str]) -> bool:
    """Whether no text has other than plain characters, told from their bytes."""
    data = "\n".join(texts).encode()
    return not data.translate(None, PLAIN_BYTES) and not any(x in data for x in OTHER_BYTES)


class Memory:
    """Values by key in two generations of at most about ``limit`` entries each."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def hold(self, keys: Iterable, learn: Callable[[list], Iterable[bytes]]) -> dict:
        """A dictionary with all ``keys``; ``learn`` gives the values of those in no generation."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new = set(keys).difference(self.young)
        if new:
            again = new.intersection(self.old)
            self.young.update(zip(again, map(self.old.__getitem__, again)))
            todo = list(new - again)
            self.young.update(zip(todo, learn(todo)))
        return self.young


class ChunkEncoder:
    """Ids of texts as bytes (``dtype`` little-endian), equal to what the library gives for each
    whole text without added special tokens."""

    def __init__(self, path: str, blanks: str, memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        self.pieces, self.chunks = Memory(memo), Memory(memo // 4)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")

    def _bytes(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def segments(self, text: str) -> Iterator[str]:
        """The text in pieces of about a million characters, cut at safe boundaries."""
        at = 0
        while len(text) - at > SEGMENT_CHARS:
            cut = CUT.search(text, at + SEGMENT_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _cut(self, texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
        """Pieces of plain texts, one text after the other, and how many each has."""
        dropped = self.blanks == "dropped"
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        if dropped:
            data = LOWER[data]
        kind = KIND[data]
        opens = np.zeros(n + 1, bool)  # the first byte of a text
        opens[np.r_[0, ends[:-1]]] = True
        begins = np.empty(n, bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= opens[:n]
        if dropped:
            begins |= kind == DIGIT
        # An apostrophe alone between something else and letters: the letters go with it.
        marks = np.flatnonzero((data[:-1] == APOSTROPHE) & (kind[1:] == LETTER) & begins[:-1] & ~opens[1:n])
        if dropped:
            begins[marks + 1] = False
        else:
            spaced = (marks > 0) & (data[marks - 1] == SPACE) & ~opens[marks]
            begins[marks[~spaced] + 1] = False
            # The last blank before other characters: a space joins them, another blank stands alone.
            last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~opens[1:n])
            begins[last] = True
            begins[last[data[last] == SPACE] + 1] = False
        at = np.flatnonzero(begins)
        sizes = np.diff(np.r_[at, n])
        if dropped:
            words = kind[at] != BLANK
            at, sizes = at[words], sizes[words]
            data = data[kind != BLANK]
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        pieces = pa.BinaryArray.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        )
        return pieces, np.diff(np.searchsorted(at, np.r_[0, ends]))

    def _learn_pieces(self, new: list[bytes]) -> list[bytes]:
        """Ids of pieces. Those that the library surely keeps apart are put together, many in a text."""
        dropped = self.blanks == "dropped"
        glue = b" " if dropped else b""

        def sure(x: bytes) -> bool:
            return x[0] != APOSTROPHE if dropped else len(x) > 1 and x[0] == SPACE and KIND[x[1]] != BLANK

        apart = [i for i, x in enumerate(new) if sure(x)]
        alone = [i for i, x in enumerate(new) if not sure(x)]
        out = [b""] * len(new)
        groups = [apart[i : i + JOINED] for i in range(0, len(apart), JOINED)]
        joined = [glue.join([new[i] for i in g]).decode() for g in groups]
        width = self.dtype.itemsize
        for group, found in zip(groups, self.tokenizer.encode_batch(joined, add_special_tokens=False)):
            word = np.asarray(found.word_ids, dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) * width
            if len(starts) != len(group):  # some are not one piece: encode them alone
                alone += group
                continue
            ids = self._bytes(found.ids)
            for i, a, b in zip(group, starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                out[i] = ids[a:b]
        for i, ids in zip(alone, self._whole([new[i].decode() for i in alone])):
            out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        pieces, counts = self._cut(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.pieces.hold(distinct, self._learn_pieces)
        found = list(map(known.__getitem__, distinct))
        width = self.dtype.itemsize
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // width
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(found), self.dtype)[np.repeat(first[index] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        data = ids.tobytes()
        return [data[a * width : b * width] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _chunked(self, text: str) -> bytes:
        if self.blanks == "dropped":
            chunks = text.replace("\n", " ").split(" ")
        elif OTHER_BLANKS.search(text):
            return self._whole([text])[0]
        else:
            chunks = BLANKS_KEPT_CHUNK.findall(text)
        return b"".join(map(self.chunks.hold(chunks, self._whole).__getitem__, chunks))

    def words(self, texts: list[str]) -> tuple[pa.BinaryArray, list[int]]:
        """What the ids of texts can be put together from, one text after the other, and how many each
        has: the pieces of plain texts, the chunks of others."""
        if self.blanks != "dropped":
            raise ValueError("only a tokenizer that drops blanks has words of its own")
        parts: list[pa.BinaryArray] = []
        counts: list[int] = []
        every = all_plain(texts)
        for group in [texts] if every else [[t] for t in texts]:
            if every or not NOT_PLAIN.search(group[0]):
                many = [list(self.segments(t)) for t in group]
                found, per_segment = self._cut([s for x in many for s in x])
                parts.append(found)
                sums = np.r_[0, np.cumsum(per_segment)]
                counts += np.diff(sums[np.r_[0, np.cumsum([len(x) for x in many])]]).tolist()
            else:
                chunks = [c.encode() for c in group[0].replace("\n", " ").split(" ") if c]
                parts.append(pa.array(chunks, pa.binary()))
                counts.append(len(chunks))
        return pa.concat_arrays(parts), counts

    def encode_words(self, new: list[bytes]) -> list[bytes]:
        """Ids of such words."""
        out = [b""] * len(new)
        texts = [w.decode() for w in new]
        plain = [i for i, t in enumerate(texts) if ONE_RUN.fullmatch(t)]
        other = [i for i, t in enumerate(texts) if not ONE_RUN.fullmatch(t)]
        for i, ids in zip(plain, self._learn_pieces([new[i] for i in plain])):
            out[i] = ids
        for i, ids in zip(other, self._whole([texts[i] for i in other])):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. New pieces of all texts are encoded together; give it batches of
        bounded size."""
        out: list[bytes | None] = [None] * len(texts)
        plain: list[int] = []
        every = all_plain(texts)
        for i, text in enumerate(texts):
            simple = every or not NOT_PLAIN.search(text)
            if len(text) <= SEGMENT_CHARS:
                if simple:
                    plain.append(i)
                else:
                    out[i] = self._chunked(text)
            elif simple:
                out[i] = b"".join(self._plain([s])[0] for s in self.segments(text))
            elif self.blanks == "kept" and OTHER_BLANKS.search(text):
                out[i] = self._whole([text])[0]
            else:
                out[i] = b"".join(map(self._chunked, self.segments(text)))
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]) if plain else []):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, blanks: str) -> ChunkEncoder:
    """One encoder per worker process and file; its memory of pieces outlives a batch."""
    return ChunkEncoder(path, blanks)


def balanced(texts: list[str], size: int = 4 * SEGMENT_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``size`` bytes together; a longer text is alone."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text.isascii() else len(text.encode())
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
