"""All registered queries."""

from planlines.plans import queries_lines, queries_pixels, queries_symbols  # noqa: F401  (registration)
from planlines.plans.registry import callables, oracle_texts  # noqa: F401
