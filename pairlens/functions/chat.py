"""Chat transcripts, message lists and reward-model conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.text import strip, word_count

# Turn markers of a transcript.
TURNS = r"(?s)(Human|Assistant):(.*?)(?=Human:|Assistant:|\z)"


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def parse_transcript(text: Column) -> Column:
    """``Human: ... Assistant: ...`` text to an array of (role, content); blank turns vanish."""
    turns = F.regexp_extract_all(text, F.lit(TURNS), F.lit(0))
    parsed = F.transform(
        turns,
        lambda t: _message(
            F.when(t.startswith("Human:"), F.lit("user")).otherwise(F.lit("assistant")),
            strip(F.regexp_replace(t, r"\A(Human|Assistant):", "")),
        ),
    )
    return F.filter(parsed, lambda m: m["content"] != "")


def ends_open(messages: Column) -> Column:
    """Whether a reply can be appended: no messages yet, or the last one is the user's."""
    return (F.size(messages) == 0) | (F.try_element_at(messages, F.lit(-1))["role"] == "user")


def ensure_user_last(messages: Column, fallback: Column, strict: bool = True) -> Column:
    """Messages ending on a user turn; empty lists become one user message with ``fallback``.

    A list ending on an assistant turn raises, or becomes null when ``strict`` is False so that
    callers can route such rows to a reject table.
    """
    reject = F.raise_error(F.lit("conversation must end with a user turn")) if strict else F.lit(None)
    return (
        F.when(F.size(messages) == 0, F.array(_message(F.lit("user"), fallback)))
        .when(F.try_element_at(messages, F.lit(-1))["role"] == "user", messages)
        .otherwise(reject.cast("array<struct<role:string,content:string>>"))
    )


def render_chat(messages: Column) -> Column:
    """Plain rendering of a conversation, one tagged block per message."""
    blocks = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]))
    return F.array_join(blocks, "\n")


def chosen_rejected(
    df: DataFrame, label: str = "label", a: str = "response_A", b: str = "response_B"
) -> DataFrame:
    """Add ``chosen`` and ``rejected``: A wins only where the label is exactly 1."""
    a_wins = F.coalesce(F.col(label) == 1, F.lit(False))
    return df.withColumns(
        {
            "chosen": F.when(a_wins, F.col(a)).otherwise(F.col(b)),
            "rejected": F.when(a_wins, F.col(b)).otherwise(F.col(a)),
        }
    )


def reward_conversations(
    df: DataFrame,
    token_count: Callable[[Column], Column] = word_count,
    strict: bool = True,
) -> DataFrame:
    """Replace text ``chosen`` / ``rejected`` by full conversations and add their length.

    ``length`` is the longer of the two rendered conversations, in tokens of ``token_count``.
    """
    missing = {"prompt", "chosen", "rejected"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")

    def reply(side: str) -> Column:
        text = strip(F.coalesce(F.col(side), F.lit("")))
        return F.concat(F.col("_history"), F.array(_message(F.lit("assistant"), text)))

    prompt = F.coalesce(F.col("prompt"), F.lit(""))
    shaped = df.withColumn("_messages", parse_transcript(prompt)).withColumn(
        "_history", ensure_user_last(F.col("_messages"), prompt, strict)
    )
    shaped = shaped.withColumns({"chosen": reply("chosen"), "rejected": reply("rejected")})
    return shaped.withColumn(
        "length",
        F.greatest(
            token_count(render_chat(F.col("chosen"))), token_count(render_chat(F.col("rejected")))
        ).cast("int"),
    ).drop("_messages", "_history")
