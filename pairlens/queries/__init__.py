"""Registered queries over the driver tables, each with the SQL it must agree with.

Operators that SQL cannot express (iterative fits, completions) are registered without SQL and
are checked against brute force in the tests.
"""

from pairlens.queries.registry import ORACLES, QUERIES
from pairlens.queries import features, models, pairs, texts  # noqa: F401  (fill the registry)

__all__ = ["ORACLES", "QUERIES"]
