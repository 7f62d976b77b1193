"""All registered queries."""

from changeweave.plans import catalog, more, wire  # noqa: F401  (importing registers)
from changeweave.plans.catalog import ORACLES, QUERIES  # noqa: F401
