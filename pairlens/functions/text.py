"""Text shaping: word counts, truncation, pair rendering and response swapping."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published formats for results to agree.
RIGHT_MARK = "[...rest of text is truncated]"
LEFT_MARK = "[start of the conversation is truncated, only showing the end...]"
HUMAN_TAG = "Human: "
ASSISTANT_TAG = "\n\nAssistant: "
OPEN_ASSISTANT = "\n\nAssistant:"
SWAP_PATTERN = r'(?s)(RESPONSE A: "Assistant: )(.*?)("\n\nRESPONSE B: "Assistant: )(.*?)(")'

# What str.split() takes for blanks: Unicode white space and the four separators \x1c-\x1f.
BLANK = r"[\s\x1c-\x1f]"
NON_BLANK = r"[^\s\x1c-\x1f]"
WORD = f"(?U){NON_BLANK}++"
EDGE_BLANKS = rf"(?U)\A{BLANK}++|(?<!{BLANK}){BLANK}++\z"

TokenCut = Callable[[Column, int, bool], Column]


def strip(text: Column) -> Column:
    """Remove blanks, Unicode ones included, from both ends."""
    return F.regexp_replace(text, EDGE_BLANKS, "")


def word_count(text: Column) -> Column:
    """Number of blank-separated words; null stays null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def length_delta(response_a: Column, response_b: Column) -> Column:
    return word_count(response_a) - word_count(response_b)


def is_valid_text(text: Column) -> Column:
    """Not null and not blank throughout; the text is read up to its first character that is no blank."""
    return text.isNotNull() & text.rlike(f"(?U){NON_BLANK}")


def text_key(text: Column) -> Column:
    """256-bit join key, so that long texts are never shuffled."""
    return F.sha2(text, 256)


def _first_words(text: Column, n: int) -> Column:
    """The text up to the end of its n-th word; '' if it has no more than n words.

    Possessive matching reads n words and never backtracks, however long the text is.
    """
    more = f"(?:{BLANK}++{NON_BLANK}++){{{n - 1}}}+" if n > 1 else ""
    return F.regexp_extract(text, rf"(?U)\A({BLANK}*+{NON_BLANK}++{more}){BLANK}++{NON_BLANK}", 1)


def _keep_words(text: Column, n: int, left: bool) -> Column:
    """The first (last) n words with the blanks between and before (after) them, or ''."""
    return F.reverse(_first_words(F.reverse(text), n)) if left else _first_words(text, n)


def truncate_col(
    text: Column,
    max_words: int | None = None,
    max_chars: int | None = None,
    left: bool = False,
    max_tokens: int | None = None,
    token_cut: TokenCut | None = None,
) -> Column:
    """Cut ``text`` to words, then characters, then tokens, and mark it if anything was cut.

    ``left=True`` keeps the end of the text. Blanks inside the kept part are preserved, and a
    text that already carries the marker is returned unchanged. ``token_cut(text, n, left)`` is
    an injected column function; a token limit needs one.
    """
    if max_words is None and max_chars is None and max_tokens is None:
        return text
    if max_tokens is not None and token_cut is None:
        raise ValueError("max_tokens needs a token_cut column function")

    marked = text.startswith(LEFT_MARK) if left else text.endswith(RIGHT_MARK)

    def with_mark(cut: Column) -> Column:
        return F.concat(F.lit(LEFT_MARK), cut) if left else F.concat(cut, F.lit(RIGHT_MARK))

    if max_chars is None and max_tokens is None:
        kept = _keep_words(text, max_words, left)
        return F.when(~marked & (kept != ""), with_mark(kept)).otherwise(text)

    cut = text
    if max_words is not None:
        kept = _keep_words(text, max_words, left)
        cut = F.when(kept != "", kept).otherwise(text)
    if max_chars is not None:
        kept = F.right(cut, F.lit(max_chars)) if left else F.substring(cut, 1, max_chars)
        cut = F.when(F.length(cut) > max_chars, kept).otherwise(cut)
    if max_tokens is not None:
        cut = token_cut(cut, max_tokens, left)
    return F.when(marked | (cut == text), text).otherwise(with_mark(cut))


def preview(text: Column, max_chars: int = 128) -> Column:
    """One-line preview of a text."""
    return F.translate(truncate_col(text, max_chars=max_chars), "\n", " ")


def _with_human_tag(prompt: Column) -> Column:
    return F.when(prompt.startswith(HUMAN_TAG), prompt).otherwise(F.concat(F.lit(HUMAN_TAG), prompt))


def prompt_response_text(prompt: Column, response: Column) -> Column:
    return F.concat(_with_human_tag(prompt), F.lit(ASSISTANT_TAG), response)


def instructed_text(prompt: Column, response: Column, instruction: str) -> Column:
    """Layout for embedders that take an instruction before the conversation."""
    return F.concat(
        F.lit(f"{instruction}\nUser: "), prompt, F.lit("\nAssistant: "), response
    )


def pairwise_text(
    prompt: Column,
    response_a: Column,
    response_b: Column,
    include_prompt: bool = True,
    max_words_prompt: int = 128,
    max_words_response: int = 128,
    compat: bool = False,
) -> Column:
    """Render one comparison as CONTEXT / RESPONSE A / RESPONSE B blocks.

    An open assistant turn at the end of the prompt is removed first; ``compat=True`` removes
    one character more, as earlier releases of this format did.
    """
    drop = len(OPEN_ASSISTANT) + (1 if compat else 0)
    closed = F.when(
        prompt.endswith(OPEN_ASSISTANT),
        F.substring(prompt, F.lit(1), F.greatest(F.length(prompt) - drop, F.lit(0))),
    ).otherwise(prompt)
    responses = F.concat(
        F.lit('RESPONSE A: "Assistant: '),
        truncate_col(response_a, max_words=max_words_response),
        F.lit('"\n\nRESPONSE B: "Assistant: '),
        truncate_col(response_b, max_words=max_words_response),
        F.lit('"'),
    )
    if not include_prompt:
        return responses
    context = truncate_col(_with_human_tag(closed), max_words=max_words_prompt, left=True)
    return F.concat(F.lit('CONTEXT: "'), context, F.lit('"\n\n'), responses)


def swap_responses(pair_text: Column) -> Column:
    """Exchange the quoted A and B responses of a rendered pair."""
    return F.regexp_replace(pair_text, SWAP_PATTERN, "$1$4$3$2$5")


def swap_if_negative(pair_text: Column, activation: Column) -> Column:
    return F.when(activation < 0, swap_responses(pair_text)).otherwise(pair_text)


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` fields of a template with columns; inserted text is never re-scanned."""
    pieces = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            pieces.append(values[piece])
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)
