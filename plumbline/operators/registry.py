"""All registered queries and their SQL."""

from plumbline.operators import aggregates, dml, joins, jsonops, more, moreops, predicates, scalars, scans, sets, sorting, windows  # noqa: F401
from plumbline.operators.base import ORACLES, QUERIES
from plumbline.plans import demo  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
