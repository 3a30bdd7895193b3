"""All registered queries, collected from the domain modules."""

from __future__ import annotations

from tidewatch.plans import config_queries, inventory_queries, lifecycle_queries, live_queries, log_queries, monitor_queries, sequential_queries, source_queries, stream_queries
from tidewatch.plans.registry import Query

_MODULES = (log_queries, source_queries, monitor_queries, inventory_queries, lifecycle_queries, config_queries, sequential_queries, stream_queries, live_queries)


def queries() -> dict[str, Query]:
    return {key: fn for module in _MODULES for key, fn in module.REG.queries.items()}


def oracles() -> dict[str, str]:
    return {key: sql for module in _MODULES for key, sql in module.REG.oracles.items()}
