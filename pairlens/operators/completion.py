"""The extension point for completion and embedding services, and offline stand-ins."""

from __future__ import annotations

import queue
import re
import threading
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.lineage import cut_lineage

# A completer answers a batch of prompts; an embedder turns a batch of texts into a matrix.
Completer = Callable[[Sequence[str]], Sequence[str | None]]
Embedder = Callable[[Sequence[str]], np.ndarray]


@dataclass(frozen=True)
class Completers:
    """A service for each role of a job."""

    interpreter: Completer
    annotator: Completer
    abbreviator: Completer

    @classmethod
    def of(cls, given: Completer | Completers) -> Completers:
        """One completer serves all roles."""
        return given if isinstance(given, cls) else cls(given, given, given)


def configured(completer: Completer, **options) -> Completer:
    """The completer with a model, token limit or other options, where they are given.

    A completer that takes options has a method ``with_options(**options)`` that returns a completer.
    """
    given = {k: v for k, v in options.items() if v not in (None, {})}
    if hasattr(completer, "with_options"):
        return completer.with_options(**given)
    if given.keys() - {"model"}:  # the model still names cache entries and steps
        raise ValueError(f"this completer takes no options, but the configuration sets {sorted(given.keys() - {'model'})}")
    return completer


def _within(seconds: float | None, completer: Completer, prompts: list[str]) -> Sequence[str | None]:
    """The completer's answers, or a TimeoutError at the deadline; a late call is left to itself."""
    if seconds is None:
        return completer(prompts)
    done: queue.Queue = queue.Queue()

    def call() -> None:
        try:
            done.put((completer(prompts), None))
        except BaseException as error:  # handed to the waiting task
            done.put((None, error))

    threading.Thread(target=call, daemon=True).start()
    try:
        found, error = done.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds} s") from None
    if error is not None:
        raise error
    return found


def ask(
    tasks: DataFrame, keys: list[str], completer: Completer, concurrency: int | None = None, batch_size: int = 64,
    timeout: float | None = None,
) -> DataFrame:
    """(keys..., answer) for every row's ``prompt``; a failing batch is retried item by item.

    ``concurrency`` bounds the number of tasks that call the service at the same time. Each batch has
    ``timeout`` seconds. Late batches are asked once more at the end of their task, unless its service
    has not answered anything: then it hangs, and the task stops asking after this one deadline.
    """

    def answers(prompts: list[str]) -> list[str | None]:
        try:
            return list(_within(timeout, completer, prompts))
        except TimeoutError:
            raise
        except Exception:
            if len(prompts) == 1:
                return [None]
            return [answer for p in prompts for answer in answers([p])]

    def run(batches):
        late, answered, hangs = [], False, False

        def result(part: pa.RecordBatch, got: list[str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(got, pa.string())], names=[*keys, "answer"])

        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                if hangs:
                    yield result(part, [None] * part.num_rows)
                    continue
                try:
                    yield result(part, answers(part.column(len(keys)).to_pylist()))
                    answered = True
                except TimeoutError:
                    late.append(part)
                    hangs = not answered
        for part in late:
            try:
                got = [None] * part.num_rows if hangs else answers(part.column(len(keys)).to_pylist())
            except TimeoutError:
                got, hangs = [None] * part.num_rows, True
            yield result(part, got)

    selected = tasks.select(*keys, "prompt")
    if concurrency is not None:
        selected = selected.repartition(concurrency)
    schema = T.StructType([*selected.schema.fields[:-1], T.StructField("answer", T.StringType())])
    return selected.mapInArrow(run, schema)


def complete(
    tasks: DataFrame,
    keys: list[str],
    completer: Completer,
    parse: Callable[[Column], Column],
    max_tries: int = 3,
    concurrency: int | None = None,
    timeout: float | None = None,
) -> DataFrame:
    """(keys..., parsed) for the tasks whose answer could be parsed within ``max_tries``.

    Every round of answers is checkpointed: a completion is paid for once, also when an
    executor is lost later. Only the tasks that failed enter the next round; with a ``timeout`` there is
    none after a round without any answer.
    """
    done, pending = None, tasks
    for _ in range(max_tries):
        round_answers = cut_lineage(
            ask(pending, keys, completer, concurrency, timeout=timeout).select(
                *keys, parse(F.col("answer")).alias("parsed"), F.col("answer").isNull().alias("_silent")
            )
        )
        good = round_answers.filter(F.col("parsed").isNotNull()).drop("_silent")
        done = good if done is None else done.unionByName(good)
        failed = round_answers.filter(F.col("parsed").isNull())
        if failed.isEmpty() or (timeout is not None and round_answers.filter("not _silent").isEmpty()):
            break
        pending = tasks.join(failed.select(*keys), keys, "left_semi")
    return done


# Traits the offline completer can tell apart, each with a count on one response.
LEXICAL_TRAITS: dict[str, Callable[[str], int]] = {
    "is written at greater length": len,
    "lists things with commas": lambda t: t.count(","),
    "uses many short sentences": lambda t: t.count("."),
    "breaks the text into lines": lambda t: t.count("\n"),
    "asks questions": lambda t: t.count("?"),
    "contains digits": lambda t: sum(c in "0123456789" for c in t),
}

# Responses may hold quotes before line ends, so a pair ends where its prompt goes on with another part.
_PAIR = re.compile(
    r'RESPONSE A: "Assistant: (.*?)"\n\nRESPONSE B: "Assistant: (.*?)"'
    r'(?=\Z|\n\nCONTEXT: "|\n\nRESPONSE A: "Assistant: |\n\nReply with one line: )',
    re.S,
)
_ONE_PAIR = re.compile(r'RESPONSE A: "Assistant: (.*?)"\n\nRESPONSE B: "Assistant: (.*)"', re.S)


def _favours(trait: str, a: str, b: str) -> int:
    count = LEXICAL_TRAITS.get(trait, len)
    return (count(a) > count(b)) - (count(a) < count(b))


def lexical_completer(prompts: Sequence[str]) -> list[str]:
    """Deterministic offline answers to this library's prompts, from surface counts."""
    return [_lexical_answer(p) for p in prompts]


def _lexical_answer(prompt: str) -> str:
    if prompt.endswith("Short form:"):
        words = prompt.rsplit("Description: ", 1)[1].rsplit("\n", 1)[0].split()
        return " ".join(w for w in words if w not in {"is", "the", "with", "into", "at"})
    letters = {1: "A", -1: "B", 0: "Tie"}
    if prompt.endswith("\nANSWER:"):
        # The one pair reaches to the last quote of the prompt but for its concepts.
        if "\nCONCEPTS:\n" in prompt.partition('RESPONSE A: "')[0]:
            block = prompt.split("\nCONCEPTS:\n", 1)[1].split("\n\n", 1)[0]
            a, b = _ONE_PAIR.findall(prompt)[0]
            return "[" + ", ".join(letters[_favours(line[2:], a, b)] for line in block.split("\n")) + "]"
        shown, _, trait = prompt.rpartition("\n\nCONCEPT: ")
        return letters[_favours(trait.rsplit("\n", 1)[0], *_ONE_PAIR.findall(shown)[0])]
    pairs = _PAIR.findall(prompt)
    votes = {t: sum(_favours(t, a, b) for a, b in pairs) for t in LEXICAL_TRAITS}
    return f'- "{max(votes, key=votes.get)}"'


class HashingEmbedder:
    """Deterministic offline embedder: signed hashed word counts, scaled to unit length."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in enumerate(texts):
            h = np.fromiter(map(zlib.crc32, map(str.encode, text.split())), np.int64)
            out[row] = np.bincount(h % self.dims, np.where(h & 0x80000000, 1.0, -1.0), self.dims)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1.0)
