"""Queries over the test tables: one per operator, with their oracles."""

from . import counts, families, filters, joins, outputs, scalars, sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
