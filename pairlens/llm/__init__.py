"""Operators that prepare training data for language models, and the queries that apply them."""

from pairlens.llm.registry import ORACLES, QUERIES
from pairlens.llm import queries  # noqa: F401  (fills the registry)

__all__ = ["ORACLES", "QUERIES"]
