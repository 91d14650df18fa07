"""All registered queries."""

from rivetgraph.plans import (  # noqa: F401
    q_claims,
    q_failures,
    q_graph,
    q_ingest,
    q_logs,
    q_metrics,
    q_quality,
    q_retention,
    q_scalars,
    q_sources,
    q_state,
    q_streaming,
    q_workers,
)
from rivetgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
