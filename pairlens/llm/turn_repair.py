"""Repair of conversation structure by a run-length dynamic program.

A conversation should read as an optional system turn and pairs of a user and an assistant turn. Rows
may be kept, get another role, be deleted or inserted, each at a cost; the cheapest repair wins, and of
equally cheap ones the one whose audit, the initials of its edits in order, comes first.

A row is a symbol: the initial of its role, and whether it must go (blank or seen before) or is
truncated. One row is a min-plus matrix over the four states of the wanted form (see ``STATES``).
Equal consecutive symbols are one run, and a run moves the vector of costs to the end by the cached
binary powers of its matrix. Within a run the choices are then unrolled row by row, from a cache as
well, since costs relative to each other take few values only.

Rows are range partitioned and sorted by conversation and turn. A task works off the conversations
that lie inside its partition as they come. What may continue in another partition, or has more
than ``SEGMENT_ROWS`` rows, becomes segments, so one conversation may hold most of the rows: the
segments find out which rows an earlier one has seen, reduce to a matrix each, get the costs behind
them from a pass over these matrices, and unroll apart for every state they may start from. A last
pass in order picks the states and feeds the repaired text to the hash, a segment at a time.

Defined results: a null role or text is one space; null turns come first; rows of equal turns are
ordered by role and text; a conversation without rows has zeros, an empty audit and the hash of
the empty text; other columns are not read; tables without rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.lineage import cut_lineage
from pairlens.llm.common import BLANKS

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40

#: The wanted form read so far: nothing, a system turn, ending on a user turn, ending on an assistant turn.
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
COMPLETE = (START, ASSISTANT)
WANTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
INITIAL_OF = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}

FINE, BLANK, SEEN, CUT = range(4)
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]
Symbol = tuple[str, bool, bool]  # initial of the role, must go, truncated


def symbol(role: str, fault: int) -> Symbol:
    if fault in (BLANK, SEEN):
        return "", True, False
    initial = role[:1]
    return initial if initial in ("s", "u", "a") else "", False, fault == CUT


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[s][k] + b[k][t] for k in STATES) for t in STATES) for s in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[s][k] + v[k] for k in STATES) for s in STATES)


IDENTITY: Matrix = tuple(tuple(0 if s == t else FAR for t in STATES) for s in STATES)


def _insertions() -> Matrix:
    rows = []
    for s in STATES:
        row, cost = [FAR] * 4, 0
        while row[s] == FAR:
            row[s], cost, s = cost, cost + INSERT, WANTED[s]
        rows.append(tuple(row))
    return tuple(rows)


INSERTIONS = _insertions()
#: Cost of completing the form behind the last row.
AT_END: Vector = tuple(min(INSERTIONS[s][t] for t in COMPLETE) for s in STATES)


@lru_cache(maxsize=None)
def transition(x: Symbol) -> Matrix:
    """Insertions, then one row of the symbol."""
    initial, gone, cut = x
    rows = []
    for s in STATES:
        row = [FAR] * 4
        row[s] = DELETE
        if not gone:
            row[WANTED[s]] = min(row[WANTED[s]], REROLE + TRUNCATED * cut)
            kept = INITIAL_OF.get((s, initial))
            if kept is not None:
                row[kept] = min(row[kept], TRUNCATED * cut)
        rows.append(tuple(row))
    return times(INSERTIONS, tuple(rows))


@lru_cache(maxsize=None)
def power(x: Symbol, bit: int) -> Matrix:
    """The transition of 2^bit rows of a symbol."""
    if bit == 0:
        return transition(x)
    half = power(x, bit - 1)
    return times(half, half)


def over_run(x: Symbol, n: int, v: Vector) -> Vector:
    """Costs before ``n`` rows of a symbol, from those behind them."""
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            v = apply(power(x, bit), v)
    return v


def runs(symbols: list[Symbol]) -> list[tuple[Symbol, int]]:
    return [(x, sum(1 for _ in same)) for x, same in groupby(symbols)]


def matrix_of(symbols: list[Symbol]) -> Matrix:
    out = IDENTITY
    for x, n in runs(symbols):
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                out = times(out, power(x, bit))
    return out


@lru_cache(maxsize=1 << 16)
def choices(x: Symbol, after: Vector) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """Costs before a row (relative to those behind it) and, for each state, the edits up to and with
    this row and the state behind it. Of equally cheap edits the one of the first initial is taken."""
    initial, gone, cut = x
    before = apply(transition(x), after)
    out = []
    for s in STATES:
        done = ""
        while True:
            left = before[s]
            if left == DELETE + after[s]:
                out.append((done + "D", s))
            elif left == INSERT + before[WANTED[s]]:
                done, s = done + "I", WANTED[s]
                continue
            elif not gone and (s, initial) in INITIAL_OF and left == TRUNCATED * cut + after[INITIAL_OF[s, initial]]:
                out.append((done + "K", INITIAL_OF[s, initial]))
            else:
                out.append((done + "R", WANTED[s]))
            break
    return before, tuple(out)


def unroll(symbols: list[Symbol], after: Vector) -> tuple[Vector, list[tuple[tuple[str, int], ...]]]:
    """Costs before the first row, and the choices of each row."""
    steps: list[list] = []
    v = after
    for x, n in reversed(runs(symbols)):
        before = over_run(x, n, v)
        inside = []
        for _ in range(n):
            least = min(v)
            v, chosen = choices(x, tuple(c - least for c in v))
            v = tuple(c + least for c in v)
            inside.append(chosen)
        if v != before:
            raise AssertionError("a run and its rows disagree")
        steps.append(inside[::-1])
    return v, [chosen for inside in reversed(steps) for chosen in inside]


def edits_from(state: int, steps: list[tuple[tuple[str, int], ...]]) -> tuple[str, int]:
    audit = []
    for chosen in steps:
        text, state = chosen[state]
        audit.append(text)
    return "".join(audit), state


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The rows that the edits leave, and the state behind them."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = WANTED[state]
            out.append((ROLE_OF[state], ""))
            continue
        if edit == "K":
            state = INITIAL_OF[state, roles[at][:1]]
            out.append((roles[at], texts[at]))
        elif edit == "R":
            state = WANTED[state]
            out.append((ROLE_OF[state], texts[at]))
        at += 1
    return out, state


def faults_of(roles: list[str], texts: list[str], seen_before: set[bytes] = frozenset()) -> list[int]:
    """The first fault of each row; ``seen_before`` holds digests of rows of earlier segments."""
    seen: set[tuple[str, str]] = set()
    out = []
    for role, text in zip(roles, texts):
        bare = text.strip(BLANKS)
        if not bare:
            out.append(BLANK)
        elif (role, text) in seen or (seen_before and row_digest(role, text) in seen_before):
            out.append(SEEN)
        else:
            out.append(CUT if bare[-1] not in ".!?" else FINE)
        seen.add((role, text))
    return out


def row_digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


class Tally:
    """Measures, audit and hash of one conversation, segment by segment."""

    def __init__(self):
        self.low = self.high = None
        self.turns = 0
        self.counts = [0] * 4
        self.illegal = self.cost = 0
        self.last = None
        self.state = START
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def turn_range(self, known: list[int]) -> None:
        """Take in the turns of a segment, ascending and without nulls."""
        if known:
            self.turns += len(set(known)) - (known[0] == self.high)
            self.low = known[0] if self.low is None else self.low
            self.high = known[-1]

    def rows(self, roles: list[str], texts: list[str], faults: list[int], audit: str) -> None:
        """Take in the rows of a segment and the edits up to its last row."""
        for role, fault in zip(roles, faults):
            self.counts[fault] += 1
            if self.last is not None and self.last + role[:1] not in LEGAL:
                self.illegal += 1
            self.last = role[:1]
        at = 0
        for edit in audit:
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit]
            if edit != "I":
                self.cost += TRUNCATED * (edit != "D" and faults[at] == CUT)
                at += 1
        self._apply(audit, roles, texts)

    def _apply(self, audit: str, roles: list[str], texts: list[str]) -> None:
        kept, self.state = repaired(audit, self.state, roles, texts)
        self.audit.append(audit)
        for role, text in kept:
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def close(self) -> None:
        """Insert what the form lacks behind the last row."""
        while self.state not in COMPLETE:
            self.cost += INSERT
            self._apply("I", [], [])

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.counts[BLANK], self.counts[SEEN], self.counts[CUT], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def whole_repair(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    """The result of a conversation that is at hand as a whole."""
    faults = faults_of(roles, texts)
    _, steps = unroll([symbol(r, f) for r, f in zip(roles, faults)], AT_END)
    tally = Tally()
    tally.turn_range([t for t in turns if t is not None])
    tally.rows(roles, texts, faults, edits_from(START, steps)[0])
    tally.close()
    return tally.result()


# The job


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): what a checksum of conversation and turn does to each row.

    ``copies`` is 0 for a dropped row, which stays so that its conversation does, and 2 for a repeated one.
    """
    blank = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    fate = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 0, "").when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate <= 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
SEGMENT_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
SEGMENT = "part int, nth bigint, turns array<bigint>, roles array<string>, texts array<string>"
PLACE = ["part", "nth"]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(conv: list, conv_type: pa.DataType, rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([pa.array(conv, conv_type), *arrays], names=["conv_id", *names])


def _first_pass(segment_rows: int):
    """Sorted rows to finished conversations, and segments of those that may go on elsewhere."""
    names = _names(RESULT) + _names(SEGMENT)
    types = RESULT_TYPES + SEGMENT_TYPES

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        nth = chars = 0
        at_hand, first, cut = None, True, False
        turns, roles, texts = [], [], []
        convs, out, kind = [], [], pa.int64()

        def segment() -> None:
            nonlocal nth, chars, turns, roles, texts
            convs.append(at_hand[0])
            out.append((*[None] * len(RESULT_TYPES), part, nth, turns, roles, texts))
            nth, chars, turns, roles, texts = nth + 1, 0, [], [], []

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if at_hand is None or conv != at_hand[0]:
                    if at_hand is not None:
                        if first or cut:
                            segment()
                        else:
                            convs.append(at_hand[0])
                            out.append((*whole_repair(turns, roles, texts), *[None] * len(SEGMENT_TYPES)))
                            chars, turns, roles, texts = 0, [], [], []
                        first = False
                    at_hand, cut = (conv,), False
                for _ in range(copies):
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    chars += len(text)
                if len(turns) >= segment_rows or chars >= SEGMENT_CHARS:
                    segment()
                    cut = True
                if len(out) >= 1000 or (out and chars == 0 and cut):
                    yield _batch(convs, kind, out, types, names)
                    convs, out = [], []
        if at_hand is not None:
            segment()  # it may go on in the next partition
        yield _batch(convs, kind, out, types, names)

    return over


def _seen_before(segments: DataFrame) -> DataFrame:
    """(part, nth, seen): digests of the rows of a segment that an earlier one of the conversation has."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, nth, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                own = {row_digest(r, t) for r, t in zip(roles, texts) if t.strip(BLANKS)}
                key = [hashlib.sha256(repr(conv).encode() + d).digest()[:16] for d in own]
                yield pa.RecordBatch.from_pydict(
                    {"key": key, "digest": list(own), "part": [part] * len(own), "nth": [nth] * len(own)},
                    schema=pa.schema([("key", pa.binary()), ("digest", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())]),
                )

    met = segments.select("conv_id", *PLACE, "roles", "texts").mapInArrow(over, "key binary, digest binary, part int, nth bigint")
    place = F.struct(*PLACE)
    first = met.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    return (
        met.join(first, "key")
        .filter(place > F.col("first"))
        .groupBy(*PLACE)
        .agg(F.collect_list("digest").alias("seen"))  # at most the rows of a segment
    )


def _marked(segments: DataFrame) -> DataFrame:
    """Segments with the fault of each row and the matrix of the segment."""
    schema = segments.schema
    names = [*schema.names, "faults", "matrix"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(len(schema)).to_pylist()
            roles, texts = (batch.column(schema.names.index(c)).to_pylist() for c in ("roles", "texts"))
            faults = [faults_of(r, t, set(s or ())) for r, t, s in zip(roles, texts, seen)]
            matrices = [
                [c for row in matrix_of([symbol(*x) for x in zip(r, f)]) for c in row] for r, f in zip(roles, faults)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(schema)], pa.array(faults, pa.list_(pa.int32())), pa.array(matrices, pa.list_(pa.int64()))],
                names=names,
            )

    joined = segments.join(_seen_before(segments), PLACE, "left").select(*schema.names, "seen")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return joined.mapInArrow(over, f"{fields}, faults array<int>, matrix array<bigint>")


def _in_order(rows: DataFrame, backward: bool = False) -> DataFrame:
    """Rows dealt by conversation, in the order of its segments."""
    by = [F.col(c).desc() if backward else F.col(c).asc() for c in PLACE]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *by)


def _costs_behind(marked: DataFrame) -> DataFrame:
    """(part, nth, behind): costs from the end of each segment to the end of its conversation."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand, v = None, AT_END
        for batch in batches:
            conv, part, nth, matrix = (c.to_pylist() for c in batch.columns)
            behind = []
            for c, m in zip(conv, matrix):
                if at_hand is None or c != at_hand[0]:
                    at_hand, v = (c,), AT_END
                behind.append(list(v))
                v = apply(tuple(tuple(m[4 * s : 4 * s + 4]) for s in STATES), v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(behind, pa.list_(pa.int64()))], names=[*PLACE, "behind"]
            )

    small = _in_order(marked.select("conv_id", *PLACE, "matrix"), backward=True)
    return small.mapInArrow(over, "part int, nth bigint, behind array<bigint>")


def _unrolled(marked: DataFrame) -> DataFrame:
    """Segments with the edits for every state that they may start from."""
    ready = marked.drop("matrix").join(_costs_behind(marked), PLACE)
    order = ["conv_id", *PLACE, "turns", "roles", "texts", "faults"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = []
            for roles, faults, behind in zip(*(batch.column(i).to_pylist() for i in (4, 6, 7))):
                _, steps = unroll([symbol(*x) for x in zip(roles, faults)], tuple(behind))
                audits.append([edits_from(s, steps)[0] for s in STATES])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(audits, pa.list_(pa.string()))], names=[*order, "audits"]
            )

    fields = ", ".join(f"{c} {marked.schema[c].dataType.simpleString()}" for c in order)
    return ready.select(*order, "behind").mapInArrow(over, f"{fields}, audits array<string>")


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to one result per conversation."""
    at_hand, tally, kind = None, None, pa.int64()
    convs, out = [], []

    def finish() -> None:
        tally.close()
        convs.append(at_hand[0])
        out.append(tally.result())

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, _, _, turns, roles, texts, faults, audits in zip(*(c.to_pylist() for c in batch.columns)):
            if at_hand is None or conv != at_hand[0]:
                if at_hand is not None:
                    finish()
                at_hand, tally = (conv,), Tally()
            tally.turn_range([t for t in turns if t is not None])
            tally.rows(roles, texts, faults, audits[tally.state])
        if len(out) >= 1000:
            yield _batch(convs, kind, out, RESULT_TYPES, _names(RESULT))
            convs, out = [], []
    if at_hand is not None:
        finish()
    yield _batch(convs, kind, out, RESULT_TYPES, _names(RESULT))


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies), see :func:`damage`: conv_id, the
    measures of its rows, the cost of the cheapest repair, its audit and the hash of the repaired rows."""
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    tie = F.xxhash64("text")
    ordered = (
        rows.select("conv_id", "turn", "role", "text", "copies")
        .repartitionByRange("conv_id", "turn", "role", tie)
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    first = cut_lineage(ordered.mapInArrow(_first_pass(segment_rows), f"{conv}, {RESULT}, {SEGMENT}"))
    finished = first.filter("part is null").select("conv_id", *_names(RESULT))
    segments = first.filter("part is not null").select("conv_id", *_names(SEGMENT))
    marked = cut_lineage(_marked(segments))
    unrolled = _in_order(cut_lineage(_unrolled(marked)))
    return finished.unionByName(unrolled.mapInArrow(_last_pass, f"{conv}, {RESULT}"))
