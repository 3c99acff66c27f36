"""Importing this module registers every query."""

from foliometry.plans import (  # noqa: F401
    queries_backtest,
    queries_ingest,
    queries_ledgers,
    queries_market,
    queries_performance,
    queries_streaming,
    queries_surface,
    queries_versions,
)
from foliometry.plans.catalog import PLANS, oracles  # noqa: F401
