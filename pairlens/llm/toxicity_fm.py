"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their beginnings of four and five characters, hashed
to 20 bits; a text is the set of its terms. The machine adds a weight per term and, for each pair
of terms, the product of their factor vectors, so a pair can count for more or less than its parts.

It is fitted on a bounded sample of the labelled rows, at most about ``max_rows`` of them and
``max_chars`` characters of text together, chosen by a hash of the id, over all terms of these rows:
none is left out for being rare or for telling nothing by itself, since it may matter in a pair. Rows
come to the driver as 32-bit term numbers and are fitted by gradient steps over batches of rows in
numpy; what a step needs beside them is made for one batch and dropped. Parameters are bounded by the
hash space. Scoring goes over all whole texts in Arrow batches.

Defined results: null and empty texts have no terms and score as the intercept says; without both
labels among the training rows every score is the smoothed share of label 1; rows without id are
scored, never trained on; a document with several labels counts as toxic if one says so; null
labels are ignored. Repeated rows are scored alike; tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.lineage import cut_lineage
from pairlens.llm.common import OWN, whole

TERM_BITS = 20
PREFIXES = (4, 5)
TERMS, LABEL = OWN + "terms", OWN + "label"


def hashed_terms(text: Column, bits: int = TERM_BITS, prefixes: tuple[int, ...] = PREFIXES) -> Column:
    """The distinct hashed terms of a text as an array of integers."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(whole(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))

    def term(kind: int, value: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), value), F.lit(1 << bits)).cast("int")

    def begins(x: Column, k: int) -> Column:
        return F.when(F.length(x) > k, term(k, F.substring(x, 1, k)))

    every = F.transform(found, lambda x: F.array(term(0, x), *[begins(x, k) for k in prefixes]))
    return F.array_compact(F.array_distinct(F.flatten(every)))


@dataclass(frozen=True)
class FactorizationMachine:
    """Terms in ascending order, the intercept, a weight and a factor vector for each term."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of rows given as concatenated term arrays."""
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        if not len(self.terms) or not len(values):
            return out
        at = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
        hit = self.terms[at] == values
        rows = np.repeat(np.arange(n), np.diff(offsets))[hit]
        at = at[hit]
        out += np.bincount(rows, self.weights[at], n)
        for column in self.factors.T:
            v = column[at]
            out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_machine(x: np.ndarray, y: np.ndarray, terms: np.ndarray, **options) -> FactorizationMachine:
    """As ``fit_rows``, for a matrix with a column of zeros and ones per term."""
    rows, at = np.nonzero(x)
    return fit_rows(at, np.searchsorted(rows, np.arange(len(x) + 1)), y, terms, **options)


def fit_rows(
    at: np.ndarray,
    offsets: np.ndarray,
    y: np.ndarray,
    terms: np.ndarray,
    n_factors: int = 8,
    steps: int = 200,
    rate: float = 0.3,
    l2: float = 1e-4,
    seed: int = 7,
    batch_rows: int = 1024,
) -> FactorizationMachine:
    """Minimise the mean log loss plus ``l2`` times the squared parameters, by Adam steps over
    batches of rows, given as concatenated positions in ``terms``.

    A term's step is in proportion to its variance over the rows, so what is in all rows
    does not compete with the intercept, and words of a single row hardly explain its label.
    """
    rng = np.random.default_rng(seed)
    m, n = len(terms), len(y)
    share = (y.sum() + 0.5) / (n + 1.0)
    p = np.bincount(at, minlength=m) / n
    pace = (4 * p * (1 - p)).astype(np.float32)
    spread = 0.05 / max(1.0, np.sqrt(len(at) / n / 10))  # long rows have many pairs
    bias, w = np.array([np.log(share / (1 - share))], np.float32), np.zeros(m, np.float32)
    v = rng.normal(0, spread, (n_factors, m)).astype(np.float32)
    parameters = [bias, w, *v]
    first, second = [np.zeros_like(x) for x in parameters], [np.zeros_like(x) for x in parameters]
    batches = np.array_split(rng.permutation(n) if n > batch_rows else np.arange(n), -(-n // batch_rows))
    for step in range(1, steps + 1):
        chosen = batches[step % len(batches)]
        lengths, truth = (offsets[1:] - offsets[:-1])[chosen], y[chosen]
        ends = np.cumsum(lengths)
        here = at[np.arange(ends[-1]) + np.repeat(offsets[chosen] - (ends - lengths), lengths)]
        row = np.repeat(np.arange(len(chosen)), lengths)
        used = np.flatnonzero(np.bincount(here, minlength=m))

        def per_row(x: np.ndarray) -> np.ndarray:
            return np.bincount(row, x[here], len(chosen))

        def per_term(r: np.ndarray) -> np.ndarray:
            return np.bincount(here, r[row], m)[used]

        summed = [per_row(f) for f in v]
        margin = bias[0] + per_row(w - 0.5 * (v**2).sum(0)) + 0.5 * sum(s * s for s in summed)
        r = (_sigmoid(margin) - truth) / len(truth)
        pull = per_term(r)
        for i, x in enumerate(parameters):  # terms of other batches rest
            if i == 0:
                where, g = slice(None), np.array([r.sum()])
            elif i == 1:
                where, g = used, pull + l2 * x[used]
            else:
                where, g = used, per_term(r * summed[i - 2]) + (l2 - pull) * x[used]
            first[i][where] = 0.9 * first[i][where] + 0.1 * g
            second[i][where] = 0.999 * second[i][where] + 0.001 * g * g
            move = rate * (first[i][where] / (1 - 0.9**step)) / (np.sqrt(second[i][where] / (1 - 0.999**step)) + 1e-8)
            x[where] -= move * pace[where] if i else move
    return FactorizationMachine(terms, float(bias[0]), w, np.ascontiguousarray(v.T))


def train(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 20_000,
    max_chars: int = 64_000_000,
) -> FactorizationMachine:
    """Fit on labelled rows for which ``training`` (a condition on the id) holds.

    The sample holds at most about ``max_rows`` rows and ``max_chars`` characters; each row's chance is
    the same, whatever its length.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
        .groupBy(id)
        .agg(F.max(label).alias(LABEL))
        .filter(training)
    )
    known = cut_lineage(known.select(F.col(id).cast("long").alias(OWN + "id"), LABEL))
    n = known.count()
    rank = F.xxhash64(F.lit(11), F.col(OWN + "id")).bitwiseAND(2**63 - 1)

    def below(share: float) -> DataFrame:
        return known.filter(rank <= F.lit(int(2**63 * min(1.0, share)) - 1))

    # At most about max_rows ids and labels: a bounded broadcast.
    share = max_rows / max(n, 1)
    candidates = docs.select(F.col(id).cast("long").alias(OWN + "id"), F.col(text).alias(OWN + "text"))
    chars = candidates.join(F.broadcast(below(share)), OWN + "id").agg(F.sum(F.length(OWN + "text"))).first()[0] or 0
    chosen = below(min(1.0, share) * min(1.0, max_chars / max(chars, 1)))
    rows = (
        candidates.join(F.broadcast(chosen), OWN + "id")
        .select((F.col(LABEL) > 0).cast("int"), hashed_terms(F.col(OWN + "text")))
        .toArrow()
    )
    y = rows.column(0).to_numpy().astype(float)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        share = (pos + 0.5) / (pos + neg + 1.0)
        empty = np.zeros(0)
        return FactorizationMachine(empty.astype(np.int32), float(np.log(share / (1 - share))), empty, np.zeros((0, 1)))
    lists = rows.column(1)
    offsets = np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())]
    at = np.concatenate([part.flatten().to_numpy(zero_copy_only=False) for part in lists.chunks])
    del rows, lists
    fitted = fit_rows(at, offsets, y, np.arange(1 << TERM_BITS, dtype=np.int32))
    met = np.flatnonzero(np.bincount(at, minlength=1 << TERM_BITS))
    return FactorizationMachine(met.astype(np.int32), fitted.bias, fitted.weights[met], fitted.factors[met])


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 added; all other columns pass through, but one already
    named as ``out``, which the score replaces."""
    docs = docs.drop(out) if text != out else docs
    names = docs.columns
    ready = docs.withColumn(TERMS, hashed_terms(F.col(text)))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(TERMS))
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            p = _sigmoid(model.margins(values, offsets - offsets[0]))
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p)], names=[*names, out])

    return ready.mapInArrow(over, schema)
