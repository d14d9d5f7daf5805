"""Text functions against plain Python string handling."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.functions import answers, chat, text

BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
TEXTS = st.lists(st.text(alphabet=BLANKS + "abé中😀\"'.", max_size=40), min_size=5, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def column(spark, texts, expr):
    rows = frame(spark, texts).select("i", expr.alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def truncated(t, words=None, chars=None, left=False):
    """What truncation means, on a Python string."""
    if t.startswith(text.LEFT_MARK) if left else t.endswith(text.RIGHT_MARK):
        return t
    out = t
    if words is not None:
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        if len(spans) > words:
            out = t[spans[-words][0]:] if left else t[: spans[words - 1][1]]
    if chars is not None and len(out) > chars:
        out = out[-chars:] if left else out[:chars]
    if out == t:
        return t
    return text.LEFT_MARK + out if left else out + text.RIGHT_MARK


@SETTINGS
@given(TEXTS)
def test_words_and_strip_follow_python(spark, texts):
    assert column(spark, texts, text.word_count(F.col("t"))) == [len(t.split()) for t in texts]
    assert column(spark, texts, text.strip(F.col("t"))) == [t.strip() for t in texts]
    assert column(spark, texts, text.is_valid_text(F.col("t"))) == [bool(t.strip()) for t in texts]


@SETTINGS
@given(TEXTS, st.integers(1, 4), st.booleans(), st.sampled_from([None, 5]))
def test_truncation(spark, texts, n, left, chars):
    texts = texts + ["a b c" + text.RIGHT_MARK, text.LEFT_MARK + "a b c d e"]
    got = column(spark, texts, text.truncate_col(F.col("t"), max_words=n, max_chars=chars, left=left))
    assert got == [truncated(t, n, chars, left) for t in texts]
    again = column(spark, got, text.truncate_col(F.col("t"), max_words=n, max_chars=chars, left=left))
    assert again == got


def test_truncation_of_a_very_long_text_does_not_overflow(spark):
    long = " ".join(["wörd"] * 200_000)
    for left in (False, True):
        got = column(spark, [long], text.truncate_col(F.col("t"), max_words=50_000, left=left))
        assert got == [truncated(long, 50_000, left=left)]


def test_no_limit_is_identity_and_null_stays_null(spark):
    assert column(spark, ["a  b"], text.truncate_col(F.col("t"))) == ["a  b"]
    assert column(spark, [None], text.truncate_col(F.col("t"), max_words=2)) == [None]
    assert column(spark, [None], text.word_count(F.col("t"))) == [None]


def test_token_limit_uses_the_injected_cut(spark):
    def cut(c, n, left):
        return F.right(c, F.lit(n)) if left else F.substring(c, 1, n)

    got = column(spark, ["abcdef"], text.truncate_col(F.col("t"), max_tokens=3, token_cut=cut))
    assert got == ["abc" + text.RIGHT_MARK]


def test_pair_text_and_swap(spark):
    prompt, a, b = "Human: hi\n\nAssistant:", "one two three", "uno dos"
    row = spark.createDataFrame([(prompt, a, b)], "p string, a string, b string")
    made = text.pairwise_text(F.col("p"), F.col("a"), F.col("b"), max_words_response=2)
    plain = row.select(made.alias("x")).first().x
    cut = "one two" + text.RIGHT_MARK
    assert plain == f'CONTEXT: "Human: hi"\n\nRESPONSE A: "Assistant: {cut}"\n\nRESPONSE B: "Assistant: uno dos"'
    swapped = row.select(text.swap_responses(made).alias("x")).first().x
    assert swapped == f'CONTEXT: "Human: hi"\n\nRESPONSE A: "Assistant: uno dos"\n\nRESPONSE B: "Assistant: {cut}"'
    assert row.select(text.swap_responses(text.swap_responses(made)).alias("x")).first().x == plain
    compat = text.pairwise_text(F.col("p"), F.col("a"), F.col("b"), compat=True)
    assert row.select(compat.alias("x")).first().x.startswith('CONTEXT: "Human: h"')
    kept = row.select(text.swap_if_negative(made, F.lit(0.0)).alias("x")).first().x
    assert kept == plain


def test_render_does_not_rescan_inserted_text(spark):
    made = text.render("<{a}|{b}>", a=F.lit("{b}"), b=F.lit("x"))
    assert spark.range(1).select(made.alias("x")).first().x == "<{b}|x>"


def test_answer_parsing(spark):
    got = column(spark, [" A\n", "b", "TIE", "both", ""], answers.parse_pairwise(F.col("t")))
    assert got == [1, -1, 0, None, None]
    assert column(spark, ["Yes ", "no", "a"], answers.parse_yes_no(F.col("t"))) == [1, 0, None]
    lists = ['["A", "B", "tie"]', "Sure: [a, b.\n'Tie', B]", "[A, x, B]", "[A, B]", "none", "[1, 2, 3]", '["A", "B", "c"]']
    got = column(spark, lists, answers.parse_multi_label(F.col("t"), 3))
    assert got == [[1, -1, 0], [1, -1, 0], None, None, None, None, None]
    raw = ['- "mentions cats"', '"- mentions cats"', ' mentions "cats ', '" - cats"']
    assert column(spark, raw, answers.clean_interpretation(F.col("t"))) == [
        "mentions cats", "mentions cats", 'mentions "cats', "cats"
    ]


def parsed_by_hand(t):
    out = []
    for piece in re.split(r"(?=Human:|Assistant:)", t):
        for tag, role in (("Human:", "user"), ("Assistant:", "assistant")):
            if piece.startswith(tag) and piece[len(tag):].strip():
                out.append((role, piece[len(tag):].strip()))
    return out


def test_transcripts(spark):
    texts = [
        "Human: hi\n\nAssistant: yo\n\nHuman: bye", "no markers", "", "pre Human: x", "Human: \n\nAssistant: a",
        "Human: a Assistant: b", "Human:Human: twice",
    ]
    got = column(spark, texts, chat.parse_transcript(F.col("t")))
    assert [[(m.role, m.content) for m in ms] for ms in got] == [parsed_by_hand(t) for t in texts]
    fixed = column(spark, texts, chat.ensure_user_last(chat.parse_transcript(F.col("t")), F.col("t"), strict=False))
    assert [None if ms is None else ms[-1].content for ms in fixed] == ["bye", "no markers", "", "x", None, None, "twice"]


def test_reward_conversations(spark):
    rows = [("Human: q", "A1", "B1 b", 1.0), ("plain", "A2", None, 0.0), ("plain", "A3", "B3", 0.5)]
    df = spark.createDataFrame(rows, "prompt string, response_A string, response_B string, label double")
    out = chat.reward_conversations(chat.chosen_rejected(df)).collect()
    assert [r.chosen[-1].content for r in out] == ["A1", "", "B3"]
    assert [r.rejected[-1].content for r in out] == ["B1 b", "A2", "A3"]
    assert out[0].length == len("<|user|>\nq\n<|assistant|>\nB1 b".split())
    assert out[1].chosen[0].content == "plain"
