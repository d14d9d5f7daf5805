import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pairlens.llm import turn_repair as tr
from tests.llm.fixtures import SF

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
WANTED = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Rows of (conv_id, turn, role, text) after damage, by the rules as they are stated."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """Uniform-cost search over edit sequences, ordered by cost and then by audit."""
    best, queue = {}, [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, form, kept = heapq.heappop(queue)
        if (at, form[:1] == "s", form[-1:], len(form) > 0) in best:
            continue
        best[at, form[:1] == "s", form[-1:], len(form) > 0] = True
        if at == len(rows) and WANTED.fullmatch(form):
            return cost, audit, list(kept)
        steps = [(2, "I", at, x, (name, "")) for name, x in (("user", "u"), ("assistant", "a"))]
        if at < len(rows):
            role, text = rows[at]
            steps.append((3, "D", at + 1, "", None))
            if wrong[at] not in ("blank", "duplicate"):
                more = wrong[at] == "truncated"
                steps.append((more, "K", at + 1, role[:1], (role, text)))
                steps += [(2 + more, "R", at + 1, name[0], (name, text)) for name in ("user", "assistant")]
        for price, edit, then, x, row in steps:
            longer = form + x
            if edit != "D" and not (x and re.fullmatch(r"s?(ua)*u?", longer)):
                continue
            heapq.heappush(queue, (cost + price, audit + edit, then, longer, kept + ((row,) if row else ())))


def brute(rows):
    """{conv_id: result} of raw rows."""
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        pairs = [(r[2], r[3]) for r in mine]
        wrong = faults(pairs)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, kept = cheapest(pairs, wrong)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, *(wrong.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def conversation(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Assistant"]
    words = ["Yes.", "No?", "so it goes", "", "  \n", None, "a long text!", "a long text!", "x\x1c", "é. "]
    weights = [2, 9, 9, 9, 9, 1, 1, 1, 1]
    rows = []
    for t in range(n):
        turn = rng.choice([t, t, t, t, t + 2, None]) if rng.random() < 0.2 else t
        text = rng.choice(words) if rng.random() < 0.4 else f"text {rng.randint(0, n)}{rng.choice(['.', '!', '', ' '])}"
        rows.append((conv, turn, rng.choices(roles, weights)[0], text))
    return rows


def table(n=150):
    rng = random.Random(5)
    rows = [r for c in range(n) for r in conversation(rng, c, rng.randint(1, 9))]
    rows += conversation(rng, 1000, 400)
    rows += [(2000, t, "user", "the same.") for t in range(300)] + [(2001, 7, "assistant", "copy.")] * 200
    rows += conversation(rng, None, 30) + [(None, None, None, None)] * 3
    return rows


def collected(df):
    got = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    return got


def test_matrices_and_powers():
    rng = random.Random(1)
    symbols = [tr.symbol(r, f) for r in ("system", "user", "assistant", "tool", "") for f in range(4)]
    for _ in range(300):
        word = [rng.choice(symbols) for _ in range(rng.randint(0, 6)) for _ in range(rng.choice([1, 1, 2, 7]))]
        step = tr.IDENTITY
        for x in word:
            step = tr.times(step, tr.transition(x))
        assert tr.matrix_of(word) == step
        before, rows = tr.unroll(word, tr.AT_END)
        assert before == tr.apply(step, tr.AT_END) and len(rows) == len(word)


def test_a_conversation_against_search():
    rng = random.Random(2)
    for i in range(400):
        rows = damaged(conversation(rng, i, rng.randint(0, 8)))
        pairs = [(r[2], r[3]) for r in rows]
        cost, audit, kept = cheapest(pairs, faults(pairs))
        got = tr.whole_repair([None] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs])
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        assert got[5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), pairs


@pytest.mark.parametrize("segment_rows", [3, 64, tr.SEGMENT_ROWS])
def test_table_with_a_hot_conversation(spark, segment_rows):
    rows = table()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    got = collected(tr.repair(tr.damage(df), segment_rows))
    assert got == brute(rows)


def test_real_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert collected(tr.repair(tr.damage(df))) == brute(rows)


def test_a_conversation_that_lost_all_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Yes.", "x")], SCHEMA)
    assert collected(tr.repair(tr.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.repair(tr.damage(empty)).count() == 0
    named = spark.createDataFrame([("c1", 0, "user", "Yes."), ("c1", 1, "assistant", "No.")], "conv_id string, turn int, role string, text string")
    assert tr.repair(tr.damage(named)).filter(F.col("conv_id") == "c1").count() == 1
