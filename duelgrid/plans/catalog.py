"""All registered queries."""

from duelgrid.plans import queries_history, queries_ingest, queries_models, queries_outcomes  # noqa: F401
from duelgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
