"""Parsing what a completion service answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.functions.text import strip

# Answer words and the codes they stand for.
PAIRWISE_ANSWERS = {"a": 1, "b": -1, "tie": 0}
YES_NO_ANSWERS = {"yes": 1, "no": 0}
LABEL_EDGE_CHARACTERS = " \t\r\n\"'`.,;:!?()[]{}"


def _lookup(word: Column, answers: dict[str, int]) -> Column:
    code = F.lit(None).cast("int")
    for text, value in answers.items():
        code = F.when(word == text, F.lit(value)).otherwise(code)
    return code


def parse_pairwise(answer: Column) -> Column:
    """'a' / 'b' / 'tie' in any case to 1 / -1 / 0, anything else to null."""
    return _lookup(F.lower(strip(answer)), PAIRWISE_ANSWERS)


def parse_yes_no(answer: Column) -> Column:
    return _lookup(F.lower(strip(answer)), YES_NO_ANSWERS)


def _label_code(word: Column) -> Column:
    return _lookup(F.lower(F.btrim(strip(word), F.lit(LABEL_EDGE_CHARACTERS))), PAIRWISE_ANSWERS)


def _complete(words: Column, n: int) -> Column:
    """The first n codes, provided every word is known and there are enough of them."""
    codes = F.transform(words, _label_code)
    usable = (F.size(codes) >= n) & ~F.exists(codes, lambda c: c.isNull())
    return F.when(usable, F.slice(codes, 1, n))


def parse_multi_label(answer: Column, n: int) -> Column:
    """Read n labels from a JSON list or from the first bracketed block; null if that fails."""
    body = strip(answer)
    as_json = F.from_json(body, "array<string>")
    bracketed = F.split(F.regexp_extract(body, r"\[([^\]]+)\]", 1), r"[,\n]+")
    return F.coalesce(_complete(as_json, n), _complete(bracketed, n))


def clean_interpretation(answer: Column) -> Column:
    """Strip list dashes and surrounding quotes from a generated description."""
    text = strip(answer)
    for opening in ("- ", '"-', '" -'):
        text = F.when(
            text.startswith(opening), F.substring(text, len(opening) + 1, 2**31 - 1)
        ).otherwise(text)
    return strip(F.btrim(text, F.lit('"')))
